"""Seven generators, their limits and scores, and the strongest seven of a project."""

import datetime

import pytest

from brandlens.operators import research as R
from brandlens.plans import analytics, registry, rules
from brandlens.sources.projection import Gathered, Projection


def test_every_generator_scores_and_the_seven_strongest_stay(spark):
    frame = spark.createDataFrame
    samples = frame([("p", 60), ("small", 4)], "project_id string, sample_size int")
    leads = R.competitor_leads(
        frame([("p", "Acme", 15.0, True), ("p", "Globex", 9.0, False), ("small", "Acme", 60.0, True)], "project_id string, competitor string, advantage double, material boolean"),
        frame([("p", "Acme"), ("p", "Acme"), ("p", "Acme"), ("p", "Globex")], "project_id string, competitor string"), samples)
    gaps = [("p", f"d{i}.example", "brand_absent", "medium", 60.0 + i, 0, 4) for i in range(12)] + [("p", "shop.acme.com", "brand_absent", "high", 99.0, 0, 9), ("p", "globex.other.org", "brand_absent", "high", 98.0, 0, 9), ("p", "weak.org", "x", "insufficient", 97.0, 0, 1), ("p", "low.org", "x", "high", 59.9, 1, 1)]
    rivals = frame([("p", "acme", "acme.com"), ("p", "globex", None), ("q", "d11", "d10.example")], "project_id string, name string, host string")
    openings = R.citation_openings(frame(gaps, "project_id string, domain string, gap_type string, confidence string, score double, brand_citations int, competitor_citations int"), rivals)
    assert sorted(r.key for r in openings.collect()) == sorted(f"citation:d{i}.example" for i in range(5, 12))  # ten looked at, three of them out
    content = R.content_openings(frame([("p", "crm", "missing_comparison", "high", 80.0), ("p", "crm", "weak_topic", "low", 61.0), ("p", "tax", "weak_topic", "high", 10.0)], "project_id string, topic string, gap_type string, confidence string, score double"))
    identity = R.weak_identity(frame([("p", True, False, 0), ("small", False, False, 0), ("fine", True, True, 2)], "project_id string, has_organization boolean, has_description boolean, same_as_links int"))
    assert {r.project_id: r.evidence for r in identity.collect()} == {"p": '{"issues":["no sameAs profiles","no description"]}', "small": '{"issues":["no organization"]}'}
    seo = R.technical_issues(frame([("p", 70.0, 0), ("small", 59.0, 0), ("q", None, 2), ("none", None, 0)], "project_id string, health_score double, critical int"))
    assert {(r.project_id, r.impact) for r in seo.collect()} == {("small", "medium"), ("q", "high")}
    names = R.emerging_names(frame([("p", f"n{i}", 0.9 - i / 100, "high" if i else "low", "new") for i in range(7)], "project_id string, name string, confidence double, label string, status string"))
    assert sorted(r.key for r in names.collect()) == ["emerging:n1", "emerging:n2", "emerging:n3", "emerging:n4"]
    claims = R.repeated_claims(frame([("p", "Acme", c) for c, n in (("is big", 4), ("is old", 3), ("is new", 3), ("is odd", 2)) for _ in range(n)], "project_id string, competitor string, claim string"), samples)
    assert sorted(r.key for r in claims.collect()) == ["claim:Acme:is big", "claim:Acme:is new"]

    found = R.findings([leads, openings, content, identity, seo, names, claims], samples)
    top = {r.project_id: [] for r in found.collect()}
    for r in sorted(found.collect(), key=lambda r: r.rank):
        top[r.project_id].append((r.key, r.score, r.confidence))
    # 25 + 25 * 0.5 + 20 + 20 + 10; 25 + 25 * 0.8 + 14 + 20 + 3; 20 + 25 * 0.71 + 20 + 20 * 2 / 3 + 6
    assert top["p"][:3] == [("competitor:Acme", 87.5, "high"), ("content:crm:missing_comparison", 82.0, "high"), ("citation:d11.example", 77.1, "medium")]
    assert len(top["p"]) == 7
    assert top["small"] == [("competitor:Acme", 90.0, "low"), ("entity:organization", 68.0, "low"), ("seo:technical", 57.0, "low")]
    assert top["q"] == [("seo:technical", 62.0, "low")]


def test_ties_go_to_the_title(spark):
    claims = R.repeated_claims(spark.createDataFrame([("p", n, "is big") for n in ("B", "A") for _ in range(3)], "project_id string, competitor string, claim string"), spark.createDataFrame([], "project_id string, sample_size int"))
    assert [r.key for r in R.findings([claims], spark.createDataFrame([("p", 30)], "project_id string, sample_size int")).orderBy("rank").collect()] == ["claim:A:is big", "claim:B:is big"]


#: Responses without citations or none that counts, citations of nothing known or without a key, places beyond the sixth.
ORDERS = [(i, (None, 1, 2, 3, 4, 99)[i % 6], "P" if i % 11 == 5 else "F", datetime.datetime(1999 + i % 4, 1 + i % 7, 1 + i % 28) if i % 13 else None, ("1-URGENT", "5-LOW", None)[i % 3]) for i in range(1, 160)]
LINES = [(None if i % 41 == 0 else i * 7 % 170, None if i % 37 == 0 else i * i % 23, None if i % 29 == 0 else i * 5 % 31, i % 9, ("A", "R", "N", None)[i * 3 % 4]) for i in range(900)]


def small(spark, folder, orders, lines):
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string"),
        "customer": ([(i, i % 25, ("BUILDING", "FURNITURE", "MACHINERY")[i % 3]) for i in range(1, 5)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(i, i % 5) for i in range(25)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(i, f"Supplier#{i:09}", i % 25) for i in range(20)] + [(7, "Supplier#twice", 3)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return Projection(spark, str(folder))


def rows_of(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=str)


@pytest.mark.parametrize("lines", [LINES, []])
def test_gathered_tables_equal_the_plain_ones(spark, tmp_path, lines):
    plain = small(spark, tmp_path, ORDERS, lines)
    gathered = Gathered.of(plain)
    assert isinstance(gathered, Gathered)
    start, end = plain.ago(730), plain.now()
    for table in (lambda p: p.cited(), lambda p: p.cited(start, end), lambda p: p.observations, lambda p: p.entity_views, lambda p: p.eligible_between(start, end)):
        columns = sorted(set(table(plain).columns) - {"status", "model", "parser_version"})
        assert rows_of(table(plain), columns) == rows_of(table(gathered), columns)
    for made in (analytics._gap_rows, analytics._relevance, rules._discovery, rules._insights, rules._topics):
        want = rows_of(made(plain))
        assert want == rows_of(made(gathered)) and (want or made is rules._insights or not lines)


def test_repeated_run_ids_and_long_responses_stay_plain(spark, tmp_path):
    plain = small(spark, tmp_path / "a", [*ORDERS, ORDERS[1]], LINES)
    assert Gathered.of(plain) is plain
    plain = small(spark, tmp_path / "b", ORDERS, [*LINES, *[(2, 1, 1, i, "A") for i in range(1000)]])
    assert Gathered.of(plain) is plain


def test_findings_shuffle_citations_once(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    plan = registry.QUERIES["research_findings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    assert spark.conf.get(key) == before
