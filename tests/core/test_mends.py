"""Operators that the review found wrong, on fixtures with the expected values."""

import pytest
from pyspark.sql import functions as F

from brandlens.functions import names as N
from brandlens.operators import accounts, citations, crawl, entities, graph, prompts, signals, site_audit, texts, visibility
from brandlens.sources.pages import parse_pages


def test_addresses_that_are_never_fetched(spark):
    values = {"64:ff9b::808:808": False, "fec0::1": False, "192.0.0.9": False, "100.100.100.200": False, "198.18.0.1": False, "240.0.0.1": False, "0.1.2.3": False, "fd00:ec2::254": False, "1.1.1.1": True, "2606:4700::1111": True, "::ffff:1.1.1.1": True, "": False}
    rows = spark.createDataFrame([(v,) for v in values], "a string").select("a", crawl.is_public_address("a").alias("p")).collect()
    assert {r.a: r.p for r in rows} == values


def test_agent_lines_that_follow_each_other_open_one_group(spark):
    body = "User-agent: *\nUser-agent: other\nDisallow: /\nCrawl-delay: 2.5\n\nUser-agent: mine\nDisallow: /x\nSitemap: https://a.example/s.xml\nCrawl-delay: 1"
    ask = lambda path, agent: crawl.robots_allowed(spark.createDataFrame([(200, body, path)], "robots_status int, robots_body string, path string"), agent).first()
    assert [ask("/a", "*").allowed, ask("/a", "other/1.0").allowed, ask("/a", "Mine/2.0").allowed, ask("/x/y", "mine").allowed] == [False, False, True, False]
    assert ask("/a", "*").crawl_delay == 2.5 and ask("/a", "mine").crawl_delay == 1.0
    assert ask("/a", "*").sitemaps == ["https://a.example/s.xml"]
    several = spark.createDataFrame([(200, body, "/a"), (200, body, "/b"), (200, body, "/a"), (404, body, "/a"), (None, None, "/a")], "robots_status int, robots_body string, path string")
    assert [r.allowed for r in crawl.robots_allowed(several, "mine").orderBy("robots_status").collect()] == [False, True, True, True, True]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("http://example.com/../a/./b//c/..", "http://example.com/a/b"),
        ("https://EXAMPLE.com:8443/", "https://example.com:8443/"),
        ("https://example.com/?utm_source=x&hsa_a=1&q=a+b&q=", "https://example.com/?q=&q=a+b"),
        ("https://münchen.example/ß", "https://xn--mnchen-3ya.example/%C3%9F"),
        ("https://example.com:99999/", None),
        ("https:///x", None),
        ("https://example.com/" + "a" * 3000, None),
    ],
)
def test_crawl_addresses(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "u string").select(crawl.normalize_crawl_url("u").alias("x")).first().x == expected


def test_relative_links_resolve(spark):
    link = lambda href: f'<a href="{href}">x</a>'
    rows = [(1, "https://a.example/d/", link("y") + link("../z") + link("//a.example/q#top") + link("#x") + link("mailto:a@b") + link("http://[broken")), (2, "https://a.example/d/y", ""), (3, "https://a.example/z", ""), (4, "https://a.example/q", ""), (5, "https://a.example/lost", "")]
    facts = parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    sources = {r.page_id: r.sources for r in site_audit.link_graph(facts, F.col("url")).collect()}
    assert sources == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_hidden_pages_have_milder_findings(spark):
    rows = [(1, "https://a.example/", '<meta name="robots" content="noindex">'), (2, "https://a.example/x", "")]
    found = {(r.page_id, r.code): r.severity for r in site_audit.findings(site_audit.page_snapshot(parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")))).collect()}
    assert found[1, "title_missing"] == "low" and found[2, "title_missing"] == "high" and found[1, "description_missing"] == "info"


def test_facts_of_entities(spark):
    make = lambda **kw: __import__("json").dumps({"@context": "https://schema.org", "@type": "https://schema.org/Organization", "name": "Acme Co, Inc.", **kw})
    rows = [(1, 0, make(slogan="A  b", offers={"@type": "Offer", "price": 1}, url="https://a.example", sku="7", identifier={"@type": "PropertyValue", "propertyID": "duns", "value": "9"})), (2, 0, make(slogan="a B", offers="other", url="https://b.example"))]
    found = entities.extract_entities(spark.createDataFrame(rows, "page_id bigint, block int, payload string"))
    top = found.where("json_path = '' AND page_id = 1").first()
    assert (top.entity_type, top.fingerprint, top.identifiers) == ("Organization", "Organization|acme", ["duns:9", "sku:7"])
    assert {(r.fingerprint, r.property) for r in entities.conflicts(found).collect()} == {("Organization|acme", "url")}


def test_organization_of_each_site(spark):
    block = lambda kind, name, **kw: __import__("json").dumps({"@type": kind, "name": name, **kw})
    rows = [
        (1, 0, block("Dentist", "Smile", url="https://www.a.example/", sameAs=["https://x.com/s", "https://x.com/s"])), (2, 0, block("Organization", "Smile", description="Teeth.", sameAs="https://x.com/t")), (2, 1, block("Organization", "Partner", url="https://p.example")), (3, 0, block("Brand", "B")), (4, 0, block("Thing", "no"))
    ]
    pages = spark.createDataFrame([("a.example", 1, "https://a.example/"), ("a.example", 2, "https://a.example/about"), ("b.example", 3, "https://b.example/x"), ("c.example", 4, "https://c.example/")], "site string, page_id bigint, url string")
    got = {r.site: r for r in entities.organization(entities.extract_entities(spark.createDataFrame(rows, "page_id bigint, block int, payload string")), pages).collect()}
    assert set(got) == {"a.example", "b.example"}
    assert (got["a.example"].name, got["a.example"].entity_type, got["b.example"].name) == ("Smile", "Dentist", "B")
    assert got["a.example"].same_as == ["https://x.com/s"]


def test_known_names_and_stop_words_are_no_discoveries(spark):
    answers = spark.createDataFrame([("r", "1. Note: x\n2. Tools - y\n3. QuickBooks Online: z\n4. Quick: a")], "response_id string, text string")
    known = spark.createDataFrame([("QuickBooks",)], "name string")
    assert {r.name for r in texts.discovered_names(answers, known).collect()} == {"Quick"}


def test_claims_are_about_whom_their_subject_names(spark):
    rows = [("p", i, i, s, "Offers", o, 0.5, c, i) for i, (s, o, c) in enumerate([("QuickBooks ", "payroll add-on", "since 2020"), ("quickbooks", "Payroll add-on", "x"), ("Ledgerly app", "3 plans", "y"), ("Ledgerly app", "3 plans", "y"), ("Wave", "free", "z")])]
    stated = spark.createDataFrame(rows, "project_id string, prompt_id int, run_id int, subject string, predicate string, object string, confidence double, context string, claimed_at int")
    got = {r.subject: (r.occurrences, r.association) for r in graph.claims(stated, "Ledgerly", ["QuickBooks", "Xero"], least=1).collect()}
    assert got == {"quickbooks": (2, "competitor"), "ledgerly app": (2, "brand"), "wave": (1, "other")}
    said = {r.entity: (r.claims, r.specific_claims, r.examples) for r in signals.claim_signals(stated, "Ledgerly", ["QuickBooks", "Xero"]).collect()}
    assert said == {"QuickBooks": (2, 1, ["QuickBooks  Offers payroll add-on"]), "brand": (2, 2, ["Ledgerly app Offers 3 plans"] * 2)}
    assert signals.new_claims(stated, ["QuickBooks", "Xero"], F.lit(1)).count() == 0 and signals.new_claims(stated, ["wave"], F.lit(1)).count() == 1


def test_a_project_of_the_window_before_stays(spark):
    data = "/root/testdata/sf0.001"
    from brandlens.sources.projection import Projection

    p = Projection(spark, data)
    observations = p.observations.where("project_id <> 1 OR completed_at < timestamp_ntz'2001-05-04'")
    rows = {r.project_id: r for r in visibility.overview(observations, p.now(), 90).collect()}
    assert rows[1].sample_size == 0 and rows[1].score is None and rows[1].previous_sample_size > 0 and rows[1].direction == "unavailable" and rows[1].sufficiency == "insufficient"


def test_scalars(spark):
    cases = [
        (N.display_name(F.lit("www.docs.example.co.uk")), "example.co.uk"), (N.display_name(F.lit("blog.com")), "blog.com"), (N.display_name(F.lit("news.example.com")), "example.com"),
        (N.host_stem(F.lit("https://www.xero.com/uk/")), "xero"), (N.host_stem(F.lit("localhost")), None),
        (N.company_key(F.lit("QuickBooks, Inc.")), "quickbooks"), (N.company_key(F.lit("Café Co Ltd")), "cafe"), (N.company_key(F.lit("Co")), "co"),
        (N.name_in(F.lit("Ledgerly"), N.slug_text(F.lit("https://g2.com/products/ledgerly?x=1"), F.lit(None).cast("string"))), True), (N.name_in(F.lit("HP"), N.slug_text(F.lit("https://g2.com/hp"), F.lit("hp"))), False),
        (N.topic_label(F.lit("What is the best accounting software for construction?")), "accounting construction"), (N.normalized_topic(F.lit("b a b")), ""), (N.normalized_topic(F.lit("beta alpha beta")), "alpha beta"),
        (N.address_category(F.lit("https://x.example/Product-vs-Rival")), "comparison"), (N.address_category(F.lit("https://x.example/a")), None),
        (N.same_site(F.lit("www.a.example"), F.lit("a.example"), False), True), (N.same_site(F.lit("b.a.example"), F.lit("www.a.example")), True), (N.same_site(F.lit("ba.example"), F.lit("a.example")), False),
        (N.backoff(F.lit(4), 2.0, 10.0), 10.0), (N.backoff(F.lit(2), 2.0, 10.0), 4.0), (N.clipped(F.lit("abcdef"), 4), "abc…"), (N.clipped(F.lit("abc"), 4), "abc"),
        (N.snippets(F.lit("x" * 60 + " word  here " + "y" * 60), "word"), ["x" * 39 + " word here " + "y" * 33]),
        (N.merged_citations(F.array(F.lit("a"), F.lit("")), F.array(F.lit("b"), F.lit("a")), 5), ["a", "b"]),
        (N.loose_date(F.lit("nope")), None),
    ]
    found = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(found) == [e for _, e in cases]


def test_whom_a_citation_speaks_of(spark):
    ours = [("p", "brand", "Ledgerly", "www.ledgerly.example"), ("p", "competitor", "QuickBooks", "quickbooks.com"), ("p", "competitor", "Xero", "xero.com"), ("q", "competitor", "Reddit", "reddit.com")]
    rows = [
        (1, "p", "ledgerly.example", None, None), (2, "p", None, "https://docs.ledgerly.example/quickbooks", None), (3, "p", "g2.com", "https://www.g2.com/compare/ledgerly-vs-quickbooks", "Xero review"),
        (4, "p", "reddit.com", "https://reddit.com/r/x", None), (5, "p", "no host", None, "Xero"), (6, "p", "quickbooks.com", "https://quickbooks.com/ledgerly", None), (7, None, "xero.com", None, None),
    ]
    frame = spark.createDataFrame(rows, "citation_id bigint, project_id string, domain string, url string, anchor string")
    known = spark.createDataFrame(ours, "project_id string, entity_type string, entity_name string, host string")
    got = {(r.citation_id, r.entity_name): r.confidence for r in citations.relationships(frame, known).collect()}
    assert got == {(1, "Ledgerly"): 0.95, (2, "Ledgerly"): 0.8, (3, "Ledgerly"): 0.7, (3, "QuickBooks"): 0.7, (3, "Xero"): 0.7, (6, "QuickBooks"): 0.95}
    flags = {r.citation_id: (r.is_brand, r.is_competitor, r.competitors) for r in citations.resolve(frame, known).collect()}
    assert flags[3] == (True, True, ["QuickBooks", "Xero"]) and flags[4] == (False, False, []) and 5 not in flags and flags[7] == (False, False, [])


def test_stored_types_are_never_forgotten(spark):
    frame = lambda rows: spark.createDataFrame(rows, "host string, domain_type string, confidence double")
    stored = frame([("a", "media", 0.9), ("b", "media", 0.9), ("c", "unknown", None), ("d", "media", 0.9), ("e", "media", 0.9)])
    fresh = frame([("a", "unknown", None), ("b", "media", 0.5), ("c", "blog", 0.6), ("d", "blog", 0.6), ("f", "blog", 0.7)])
    got = {r.host: (r.domain_type, r.confidence) for r in citations.stored_classification(stored, fresh).collect()}
    assert got == {"a": ("media", 0.9), "b": ("media", 0.9), "c": ("blog", 0.6), "d": ("blog", 0.6), "e": ("media", 0.9), "f": ("blog", 0.7)}


def test_prompt_quality(spark):
    profile = {"company": ["ledgerly"], "offering": ["accounting"], "audience": ["builders"], "competitor": ["xero"], "descriptor": [], "geo": []}
    rows = [("Best accounting for builders compared to Xero in practice", "comparison", 0.0), ("What is it", "discovery", 1.0), (None, "pricing", None)]
    out = prompts.prompt_quality(spark.createDataFrame(rows, "text string, category string, max_similarity double"), profile).collect()
    assert [(r.relevance, r.uniqueness, r.commercial_intent, r.specificity) for r in out[:2]] == [(1.0, 1.0, 0.95, 1.0), (0.0, 0.0, 0.35, 0.1)]
    assert [r.priority for r in out] == [1, 5, 3] and out[0].quality_score == 98.6


def test_audits(spark):
    fresh = spark.createDataFrame([("a", None), ("a", "u"), ("b", "u")], "code string, url string")
    before = spark.createDataFrame([("a", None, "ignored"), ("b", "u", "open"), ("a", None, "ignored")], "code string, url string, status string")
    assert sorted((r.code, r.url or "", r.status) for r in accounts.carry_ignored(fresh, before).collect()) == [("a", "", "ignored"), ("a", "u", "open"), ("b", "u", "open")]
    pages = spark.createDataFrame([("s", 503), ("s", 404), ("s", 404), ("s", 200), ("s", 301)], "site string, http_status int")
    urls = spark.createDataFrame([("s", ["a", "b"], None), ("s", ["a"], None), ("s", None, "too many redirects")], "site string, redirects array<string>, error string")
    got = {(r.code, r.severity, r.affected) for r in accounts.http_findings(pages, urls).collect()}
    assert got == {("server_error", "high", 1), ("client_error", "medium", 2), ("non_200", "info", 1), ("redirect_chain", "medium", 1), ("redirected_urls", "info", 1), ("redirect_loop", "high", 1)}
