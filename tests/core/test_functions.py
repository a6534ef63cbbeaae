"""Known values of scores, rounding, URLs and text rules."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from brandlens.functions import ladders as L
from brandlens.functions import text as T
from brandlens.functions import urls as U
from brandlens.plans import registry
from brandlens.sources import registry as R


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_position_points(spark):
    rows = spark.range(1, 8).select(L.position_points(F.col("id")).alias("p")).collect()
    assert [r.p for r in rows] == [100, 85, 70, 55, 40, 25, 25]
    assert one(spark, L.position_points(F.lit(None).cast("int"))) is None


@pytest.mark.parametrize("sample, value, expected", [(3, 63.7, None), (8, 63.7, 65.0), (25, 63.7, 64.0), (80, 63.74, 63.7), (8, 62.5, 60.0), (25, 62.5, 62.0)])
def test_rounding_by_sample(spark, sample, value, expected):
    assert one(spark, L.round_for(F.lit(sample), F.lit(value))) == expected


def test_round_even_is_that_of_sql(spark):
    values = [(sign * f(tie / 10 ** (n + 1)), n) for n in (0, 1, 3) for tie in range(5, 6000, 70) for f in (float, lambda x: math.nextafter(x, 9e9), lambda x: math.nextafter(x, 0.0)) for sign in (1, -1)] + [(31.0 * 0.85, 1), (None, 1)]
    got = spark.createDataFrame(values, "v double, n int").select("v", "n", *[L.round_even(F.col("v"), n).alias(str(n)) for n in (0, 1, 3)]).collect()
    sql = duckdb.connect()
    for r in got:
        assert r[str(r.n)] == sql.execute("SELECT round_even(CAST(? AS DOUBLE), ?)", [r.v, r.n]).fetchone()[0], r


def test_unavailable_is_null_and_not_zero(spark):
    null = F.lit(None).cast("double")
    assert one(spark, L.available_mean({"a": (null, 25.0), "b": (F.lit(40.0), 75.0)})) == 40.0
    assert one(spark, L.available_mean({"a": (null, 25.0)})) is None
    assert one(spark, L.share(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize("days, expected", [(0, 100), (7, 100), (30, 60), (90, 20), (180, 0), (400, 0)])
def test_recency(spark, days, expected):
    assert one(spark, L.recency(F.lit(float(days)))) == pytest.approx(expected)


@pytest.mark.parametrize(
    "sentiments, expected",
    [(["positive", "unknown"], "positive"), (["positive", "negative"], "mixed"), (["neutral", "negative"], "negative"), (["unknown"], "unknown"), (["mixed", "positive"], "mixed"), (["neutral"], "neutral")],
)
def test_folded_sentiment(spark, sentiments, expected):
    assert spark.createDataFrame([(s,) for s in sentiments], "s string").agg(L.folded_sentiment(F.col("s")).alias("x")).first()["x"] == expected


HOSTS = [(" WWW.Example.COM. ", "example.com"), ("https://www.a-b.example.org:8080/x?y#z", "a-b.example.org"), ("localhost", None), ("http://user@shop.example.com/", "shop.example.com"), ("bad_host.com", None), ("", None), (None, None)]


def test_hosts(spark):
    rows = spark.createDataFrame(HOSTS, "raw string, expected string").withColumns({"jvm": U.normalize_host(F.col("raw")), "idna": U.normalize_host_idna("raw")}).collect()
    for r in rows:
        assert r.jvm == r.expected, r
        assert r.idna == r.expected, r
    assert spark.createDataFrame([("https://www.bücher.example/",)], "raw string").select(U.normalize_host_idna("raw").alias("x")).first().x == "xn--bcher-kva.example"


URLS = [
    ("HTTP://www.Example.com:80//a//b/?utm_source=x&b=2&a=1#top", "http://example.com/a/b?a=1&b=2"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com/a/?ref=x", "https://example.com/a"),
    ("https://example.com:8443/p?q", "https://example.com:8443/p?q="),
    ("mailto:a@example.com", None),
    ("ftp://example.com/x", None),
    (None, None),
]


def test_urls(spark):
    rows = spark.createDataFrame(URLS, "raw string, expected string").withColumns({"plain": U.normalize_plain_url(F.col("raw")), "full": U.normalize_url("raw")}).collect()
    for r in rows:
        assert r.full == r.expected, r
        assert r.plain in (None, r.expected), r


def test_host_suffixes_and_platform(spark):
    assert one(spark, U.host_suffixes(F.lit("a.b.example.com"))) == ["a.b.example.com", "b.example.com", "example.com"]
    assert one(spark, U.platform(F.lit("scholar.google.com"))) == "google"
    assert one(spark, U.platform(F.lit("play.google.com"))) == "google_play"
    assert one(spark, U.platform(F.lit("notx.com"))) == "other"


@pytest.mark.parametrize(
    "prompt, category, intent, stage",
    [
        ("How much does Acme cost?", "pricing", "transactional", "decision"),
        ("Acme vs Globex", "comparison", "commercial", "consideration"),
        ("plumbers in Berlin", "local", "commercial", "decision"),
        ("How to use Acme after login", "problem_solution", "navigational", "retention"),
        ("hello", "discovery", "informational", "awareness"),
    ],
)
def test_prompts(spark, prompt, category, intent, stage):
    found = {k: one(spark, c, t=prompt) for k, c in T.classify_prompt(F.col("t")).items()}
    assert found == {"category": category, "intent": intent, "stage": stage}


def test_judge(spark):
    said = lambda s: tuple(one(spark, c, t=s) for c in T.judge(F.col("t")).values())
    assert said("Acme is the best choice.") == ("positive", "strong")
    assert said("Acme lacks reports.") == ("negative", "none")
    assert said("It is reliable but expensive.") == ("mixed", "moderate")
    assert said("It exists.") == ("neutral", "unknown")


def test_text_measures_of_null_and_empty(spark):
    for value in (None, "", "  \n "):
        found = {k: one(spark, c, t=value) if value is not None else spark.range(1).select(T.text_metrics(F.lit(None).cast("string"))[k].alias("x")).first().x for k, c in T.text_metrics(F.col("t")).items()}
        assert found["words"] == 0 and found["sentences"] == 0


def test_fold_and_tokens(spark):
    df = spark.createDataFrame([("Best CRM tools for parties, Zoë!",), (None,)], "t string")
    rows = df.select(T.content_tokens(T.normalize_prompt(F.col("t"))).alias("x")).collect()
    assert rows[0].x == ["best", "crm", "party", "tool", "zoe"]
    assert rows[1].x is None


ODD = ["enöbest one", "bestß", "best́", "Ǽtop pick", "It iſ the beſt.", "weaK", "lacKs", "a#\u000b1", "a# 1x", "a#\t1 ", "a#11", "#1", "can't x", "cannot é", "can not.", "çavoid", "_avoid", "9poor", "user‑friendly", "ΩPOOR Ω", "TİPıC best", "x​top", "é. É", "", "well—suited great. pricey"]


def test_sentences_are_judged_as_by_sql(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(ODD)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    whole = lambda rows: sorted(tuple(r) for r in rows)
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert whole(registry.QUERIES["sentiment_judge"](spark, str(tmp_path)).collect()) == whole(sql.execute(registry.ORACLE_SQL["sentiment_judge"]).fetchall())
    patterns = (R.NEGATIVE, R.POSITIVE, R.STRONG, R.MODERATE, R.WEAK)
    for r in spark.createDataFrame([(t,) for t in ODD], "t string").select("t", *[T.as_sql_text(F.col("t")).rlike(T.as_sql_pattern(p)).alias(str(i)) for i, p in enumerate(patterns)]).collect():
        assert list(r[1:]) == [sql.execute("SELECT regexp_matches(?, ?)", [r.t, p]).fetchone()[0] for p in patterns], repr(r.t)
