"""Structured data in attributes, headings, canonicals, click depths: fixtures with the expected values."""

import json

from pyspark.sql import functions as F

from brandlens.operators import entities, site_audit
from brandlens.sources.pages import parse_pages

PAGES = "page_id bigint, url string, html string"
ITEMS = """<p>open<div itemscope itemtype="https://schema.org/Organization https://schema.org/Store" itemid="x"><p><span itemprop="name">Acme <b>Inc</b></span>
<a itemprop="url sameAs" href="https://a.example">site</a><a itemprop="sameAs" href="https://b.example">b</a><meta itemprop="telephone" content="1">
<div itemprop="address" itemscope itemtype="PostalAddress"><li itemprop="street">One<li itemprop="street">Two</div><div itemscope itemtype="Lost"><i itemprop="name">no</i></div>
<script>var x</script><time itemprop="founded" datetime="1999">then</time><img itemprop="logo" src="/l.png"></div>
<div typeof="schema:Person" resource="#me"><span property="schema:name">Jo</span></div><meta property="og:title" content="t">"""


def test_items_in_attributes(spark):
    rows = [(1, "https://a.example/", ITEMS), (2, "https://a.example/x", "<p itemprop=name>none"), (3, None, None), (4, "u", '<div itemscope itemtype="T">' * 5000 + "deep")]
    blocks = {r.page_id: r.blocks for r in parse_pages(spark.createDataFrame(rows, PAGES)).collect()}
    micro, rdfa = blocks[1]
    assert (micro.format, rdfa.format, micro.is_valid) == ("microdata", "rdfa", True)
    assert json.loads(micro.payload) == [
        {"@type": ["Organization", "Store"], "@id": "x", "name": "Acme Inc", "url": "https://a.example", "sameAs": ["https://a.example", "https://b.example"], "telephone": "1", "address": {"@type": "PostalAddress", "street": ["One", "Two"]}, "founded": "1999", "logo": "/l.png"}
    ]
    assert json.loads(rdfa.payload) == [{"@type": "Person", "@id": "#me", "name": "Jo"}]
    assert blocks[2] == [] and blocks[3] == [] and json.loads(blocks[4][0].payload) == [{"@type": "T"}]
    found = entities.extract_entities(parse_pages(spark.createDataFrame(rows[:1], PAGES)).select("page_id", F.posexplode("blocks").alias("block", "b")).select("page_id", "block", "b.payload")).collect()
    assert {(r.entity_type, r.name) for r in found} == {("Organization", "Acme Inc"), ("PostalAddress", None), ("Person", "Jo")}


def test_items_deeper_than_six_keep_their_type(spark):
    html = "".join(f'<div itemscope itemtype="T{k}" {"itemprop=in" if k else ""}><b itemprop=n>{k}</b>' for k in range(9))
    item = json.loads(parse_pages(spark.createDataFrame([(1, "u", html)], PAGES)).first().blocks[0].payload)[0]
    depth = 0
    while "in" in item:
        item, depth = item["in"], depth + 1
    assert (depth, item) == (6, {"@type": "T6"})


def test_faults_of_blocks(spark):
    script = '<script type="application/ld+json">{}</script>'.format
    html = script(" ") + script('{"a":"' + "b" * 70_000 + '"}') + script("{") + script("[1]") + script("[" * 30_000)
    facts = parse_pages(spark.createDataFrame([(1, "u", html)], PAGES))
    errors = [(b.is_valid, (b.error or "")[:12]) for b in facts.first().blocks]
    assert errors == [(False, "empty block"), (False, "block too la"), (False, "invalid JSON"), (True, ""), (False, "invalid JSON")]
    codes = {r.code for r in site_audit.findings(site_audit.page_snapshot(facts)).collect()}
    assert "structured_data_invalid" in codes and "structured_data_missing" not in codes


def test_heading_findings(spark):
    rows = [(1, "u", "<h2>A</h2><h4>b</h4>"), (2, "u", "<h1>A</h1><h2>a </h2>"), (3, "u", f"<h1>{'x' * 71}</h1>"), (4, "u", "<h1>A</h1><h2>B</h2><h3>C</h3><h1></h1><h1></h1>"), (5, "u", None)]
    found = site_audit.heading_findings(site_audit.page_snapshot(parse_pages(spark.createDataFrame(rows, PAGES)))).collect()
    assert {(r.page_id, r.code) for r in found} == {(1, "heading_hierarchy_skipped"), (2, "heading_duplicate"), (3, "heading_too_long")}


def test_canonical_findings(spark):
    at = lambda *urls: "".join(f'<link rel="canonical" href="{u}">' for u in urls)
    rows = [
        (1, "https://a.example/1", at("https://a.example/1"), 200), (2, "https://a.example/2", at("https://a.example/1"), 200), (3, "https://a.example/3", at("https://a.example/2"), 200), (4, "https://www.a.example/4", at("https://b.example/"), 200),
        (5, "https://a.example/5", at("https://shop.a.example/5"), 200), (6, "https://a.example/6", at("x", "y"), 200), (7, "https://a.example/7", '<meta name=robots content=none>', 404), (8, "https://a.example/8", at("https://a.example/7"), 200), (9, "https://a.example/9", "", 200),
        (10, "https://a.example/1", at("https://a.example/2"), 500),
    ]
    table = spark.createDataFrame(rows, PAGES + ", http_status int")
    snapshot = site_audit.page_snapshot(parse_pages(table)).join(table.select("page_id", "http_status"), "page_id")
    found = {r.page_id: (r.code.removeprefix("canonical_"), r.severity) for r in site_audit.canonical_findings(snapshot, "http_status").collect()}
    assert found == {2: ("mismatch", "info"), 3: ("chain", "medium"), 4: ("external", "high"), 5: ("mismatch", "info"), 6: ("conflicting", "high"), 7: ("missing", "info"), 8: ("target_not_ok", "high"), 9: ("missing", "low"), 10: ("chain", "medium")}
    assert {r.page_id: r.code for r in site_audit.canonical_findings(snapshot).collect()}[8] == "canonical_mismatch"


def test_link_findings(spark):
    link = lambda *ids: "".join(f'<a href="/{i}">x</a>' for i in ids)
    rows = [(10, "https://a.example/", link(1, 2)), *[(i, f"https://a.example/{i}", link(i + 1, 1)) for i in range(1, 7)], (7, "https://a.example/7", ""), (8, "https://a.example/8", link(8)), (9, "https://other.example/x", ""), (11, None, None)]
    facts = parse_pages(spark.createDataFrame(rows, PAGES))
    assert {r.page_id for r in site_audit.home_pages(facts).collect()} == {9, 10}
    depths = {r.page_id: r.depth for r in site_audit.click_depths(site_audit.page_edges(facts, F.col("url")), site_audit.home_pages(facts)).collect()}
    assert depths == {9: 0, 10: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6}
    found = {(r.page_id, r.code) for r in site_audit.link_findings(facts, F.col("url")).collect()}
    assert found == {(8, "orphan_pages"), (11, "orphan_pages"), *[(i, "few_internal_links") for i in range(3, 8)], (6, "excessive_link_depth"), (7, "excessive_link_depth")}


def test_no_pages(spark):
    facts = parse_pages(spark.createDataFrame([], PAGES))
    assert site_audit.audit_findings(facts, F.col("url")).count() == 0


def test_broken_links_are_found_by_page(spark):
    links = spark.createDataFrame([(1, "broken"), (1, "broken"), (2, "ok"), (3, None), (4, "unknown"), (5, "broken")], "page_id bigint, status string")
    found = [tuple(r) for r in site_audit.broken_link_findings(links).orderBy("page_id").collect()]
    assert found == [("broken_internal_links", "high", "internal_links", 1), ("broken_internal_links", "high", "internal_links", 5)]
