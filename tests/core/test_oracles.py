"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from brandlens.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (bool, type(None))):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_takes_empty_tables(spark, tmp_path):
    for path in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(str(tmp_path / os.path.basename(path)))
    for name in ("visibility_metrics", "citation_gaps", "graph_sources_top", "insights", "alerts_period_rules", "project_sources", "seo_findings", "prompt_near_duplicates", "language_detect",
                 "content_gaps_by_topic", "visibility_own_rivals", "competitive_own_rivals", "entity_references", "page_entities", "answer_blocks", "answer_listed_citations", "crawl_best_first", "crawl_sitemap_pages",
                 "verification_lifecycle", "issue_islands", "research_findings", "gap_evidence", "gaps_naming_competitor", "readiness_signals", "brand_profiles"):
        assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0, name
