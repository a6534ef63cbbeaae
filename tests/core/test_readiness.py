"""Site readiness and page reviews on small sites."""

from pyspark.sql import functions as F

from brandlens.operators import readiness, site_audit
from brandlens.sources.pages import parse_pages

HOME = '<html><head><title>Acme - payroll</title><meta name=description content="Acme is payroll software that pays people on time every month"></head><body><h1>Acme</h1><p>Built for teams. Based in Berlin. Mail a@acme.example.</p></body></html>'
PRODUCT = "<html><head><title>Acme Pay</title></head><body><h1>Pay</h1><h2>Features</h2><p>" + "It pays 100 people in 3 days. " * 35 + "Works with Slack. Pricing from $5.</p></body></html>"
BARE = "<html><body><p>nothing</p></body></html>"


def snapshot(spark, rows):
    return site_audit.page_snapshot(parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")))


def test_site(spark):
    rows = [(1, "https://www.acme.example/", HOME), (2, "https://acme.example/products/pay", PRODUCT), (3, "https://bare.example/x", BARE)]
    out = {r.site: r for r in readiness.site_readiness(readiness.page_aspects(snapshot(spark, rows))).collect()}
    acme, bare = out["acme.example"], out["bare.example"]
    assert acme.entity_clarity == 1.0 and acme.authority is None and acme.faq is None
    assert acme.product_clarity > 0.5 and acme.content_structure > 0.9
    assert bare.product_clarity is None and bare.evidence is None and bare.entity_clarity == 0.0
    assert acme.score > bare.score


def test_conflicts_count(spark):
    rows = [(1, "https://www.acme.example/", HOME)]
    facts = spark.createDataFrame([("acme.example", 4, 1)], "site string, entities int, conflicts int")
    assert readiness.site_readiness(readiness.page_aspects(snapshot(spark, rows)), facts).first().factual_consistency == 0.75


def test_reviews(spark):
    text = "Acme is designed for teams that need to pay people. " + "Our powerful platform does many things for you today. " * 2 + "It is the fastest way to pay anyone at all in town. " + "It is calm and it works on every day of the week. " * 3
    rows = [(1, "https://acme.example/", f"<html><body><p>{text}</p></body></html>"), (2, "https://acme.example/x", BARE), (3, None, None)]
    pages = snapshot(spark, rows)
    row = readiness.page_reviews(pages, F.lit("Acme"), has_organization=F.lit(True)).collect()
    assert [(r.page_id, r.unclear, r.vague, r.unsupported, r.score) for r in row] == [(1, False, 1, 1, 90)]
    assert readiness.page_reviews(pages, F.lit("Acme"), F.lit(2)).first().score == 65
