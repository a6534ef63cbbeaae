"""Crawl operators and view rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from brandlens.operators import crawl, views

ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\nUser-agent: bad\nDisallow: /"


@pytest.mark.parametrize(
    "status, body, path, allowed",
    [(200, ROBOTS, "/", True), (200, ROBOTS, "/private/x", False), (200, ROBOTS, "/private/open/y", True), (200, ROBOTS, "/a/b.pdf", False), (404, "Disallow: /", "/", True), (503, ROBOTS, "/", False), (None, None, "/", False), (200, None, "/", True)],
)
def test_robots(spark, status, body, path, allowed):
    df = spark.createDataFrame([(status, body, path)], "robots_status int, robots_body string, path string")
    assert crawl.robots_allowed(df).first().allowed is allowed


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("HTTP://Example.com:80/a/./b/../c/?utm_id=1&b=2&a=1#x", "http://example.com/a/c?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com/%7Euser/a b", "https://example.com/~user/a%20b"),
        ("https://u:p@example.com/", None),
        ("ftp://example.com/", None),
        ("", None),
        (None, None),
    ],
)
def test_crawl_urls(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "u string").select(crawl.normalize_crawl_url("u").alias("x")).first().x == expected


def test_public_addresses(spark):
    values = {"8.8.8.8": True, "10.0.0.1": False, "127.0.0.1": False, "169.254.1.1": False, "::1": False, "2001:4860:4860::8888": True, "::ffff:10.0.0.1": False, "224.0.0.1": False, "x": False}
    rows = spark.createDataFrame([(v,) for v in values], "a string").select("a", crawl.is_public_address("a").alias("p")).collect()
    assert {r.a: r.p for r in rows} == values


def test_sitemaps(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/1</loc></url><url><loc>https://b.example/2</loc></url></urlset>'
    rows = [("https://a.example/s.xml", xml), ("https://a.example/i.xml", "<sitemapindex><sitemap><loc>https://a.example/s.xml</loc></sitemap></sitemapindex>"), ("https://a.example/d.xml", "<!DOCTYPE x>" + xml), ("https://a.example/e.xml", "<broken"), (None, None)]
    found = {tuple(r) for r in crawl.sitemap_urls(spark.createDataFrame(rows, "sitemap_url string, xml string")).collect()}
    assert found == {("https://a.example/s.xml", "page", "https://a.example/1"), ("https://a.example/i.xml", "index", "https://a.example/s.xml")}


def test_frontier_stops_at_depth_and_budget(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x.png"), ("b", "a")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in crawl.frontier(seeds, links, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r.url for r in crawl.frontier(seeds, links, 5, max_pages=2).collect()] == ["a", "b"]


def test_language_order(spark):
    pick = lambda *v: spark.range(1).select(crawl.language_of(*[F.lit(x).cast("string") for x in v[:3]], F.lit(0.4)).alias("l")).first().l
    assert tuple(pick("en-US", "de", "fr")) == ("en", "html_lang", 1.0)
    assert tuple(pick("??", "de", "fr")) == ("de", "metadata", 0.9)
    assert tuple(pick(None, None, "fr")) == ("fr", "detected", 0.4)
    assert pick(None, None, None) is None


def test_websites(spark):
    values = {"https://acme.example.com/x": True, "acme.com": True, "http://10.0.0.1/": False, "https://u@acme.com": False, "acme": False, "javascript:alert(1)": False}
    rows = spark.createDataFrame([(v,) for v in values], "u string").select("u", crawl.valid_website(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == values


def test_views(spark):
    assert spark.range(1).select(views.overall_score([F.lit(80.0), F.lit(None).cast("double"), F.lit(60.0)]).alias("x")).first().x == 70.0
    assert spark.range(1).select(views.overall_score([F.lit(None).cast("double")]).alias("x")).first().x is None
    ok = lambda a, b: spark.range(1).select(views.allowed_transition(F.lit(a), F.lit(b), views.RECOMMENDATION_STATES).alias("x")).first().x
    assert ok("new", "approved") and not ok("new", "completed") and not ok("completed", "new")
    trend = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, 1.0), ("b", 2, 2.0)], "k string, t int, v double")
    assert {r.k for r in views.trend_series(trend, ["k"], "v").collect()} == {"b"}
