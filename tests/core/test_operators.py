"""Operators on small fixtures: rules the projected tables can't exercise."""

import datetime

import pytest
from pyspark.sql import functions as F

from brandlens.functions import names as N
from brandlens.operators import entities, gaps, operations, signals, site_audit, texts
from brandlens.operators.keywords import keyword_hits
from brandlens.sources.pages import parse_pages


def test_gap_types_in_order(spark):
    columns = "brand_citations int, competitor_citations int, responses int, citations int, first_half int, second_half int, first_cited_at timestamp_ntz, expected string"
    old, new = datetime.datetime(2001, 1, 1), datetime.datetime(2001, 7, 20)
    rows = [
        (0, 0, 3, 4, 0, 4, new, "emerging_source"),
        (0, 1, 1, 1, 1, 0, old, "brand_absent"),
        (0, 0, 2, 2, 1, 1, old, "source_underrepresented"),
        (3, 55, 40, 60, 30, 30, old, "competitor_advantage"),
        (5, 5, 9, 12, 6, 6, old, "shared_source"),
        (38, 0, 30, 40, 20, 20, old, "source_overrepresented"),
        (1, 0, 5, 9, 4, 5, old, "source_underrepresented"),
    ]
    df = spark.createDataFrame(rows, columns).withColumn("got", gaps.gap_type(F.lit("2001-08-02").cast("timestamp_ntz"), 90))
    assert [r.got for r in df.collect()] == [r[-1] for r in rows]


def test_recommendations_round_beside_a_tie_as_sql_does(spark):
    schema = "project_id int, domain string, domain_type string, gap_type string, confidence string, score double, source_relevance double, brand_citations int, competitor_citations int, responses int, prompts int, commercial_prompts int"
    rows = [(1, "a.example", "media", "brand_absent", "medium", 31.0, 50.0, 0, 3, 9, 4, 4)]
    got = {r.domain: (r.priority_score, r.business_relevance) for r in gaps.recommendations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a.example": (26.4, 1.0)}  # 31 * 0.85 is 26.349999999999998 as a double


def test_merge_keeps_what_people_decided_and_is_idempotent(spark):
    existing = spark.createDataFrame([("a", None, 1, "new"), ("b", None, 2, "dismissed"), ("c", "p", 3, "new")], "domain string, page string, score int, status string")
    fresh = spark.createDataFrame([("a", None, 10), ("c", "q", 30)], "domain string, page string, score int")
    once = operations.merge(existing, fresh, ["domain", "page"], ["status"], {"status": "new"})
    twice = operations.merge(once, fresh, ["domain", "page"], ["status"], {"status": "new"})
    expected = {("a", None, 10, "new"), ("b", None, 2, "dismissed"), ("c", "q", 30, "new")}
    assert {tuple(r) for r in once.collect()} == expected == {tuple(r) for r in twice.collect()}


def test_cost_rounds_half_up(spark):
    assert float(spark.range(1).select(operations.cost(F.lit(1), F.lit(1), "0.25", "0.25").alias("c")).first().c) == 0.000001
    assert float(spark.range(1).select(operations.cost(F.lit(None).cast("int"), F.lit(1000000), "5", "2").alias("c")).first().c) == 2.0


def test_link_status(spark):
    links = spark.createDataFrame([(1, "u1"), (1, "u2"), (1, "u3")], "page_id int, normalized_url string").select(F.col("page_id").alias("source_id"), "normalized_url")
    pages = spark.createDataFrame([(7, "u1", 200), (8, "u2", 404)], "page_id int, normalized_url string, http_status int")
    assert {r.normalized_url: r.status for r in operations.link_status(links, pages).collect()} == {"u1": "ok", "u2": "broken", "u3": "unknown"}


def test_topics_match_pages_by_half_their_keywords(spark):
    topics = spark.createDataFrame([(1, ["invoice", "construction", "crew"]), (2, ["tax"]), (3, ["boat", "sail"])], "topic_id int, keywords array<string>")
    pages = spark.createDataFrame([(1, "https://x/construction-invoices", "Invoices", None, 500), (2, "https://x/tax", None, None, 20), (3, "https://x/row", "rowing boat", None, None)], "page_id int, url string, title string, meta string, word_count int")
    assert {r.topic_id: (r.pages, r.coverage) for r in signals.match_pages(topics, pages).collect()} == {1: (1, 1.0), 2: (1, 0.4), 3: (1, 0.4)}


def test_topics_match_pages_of_their_project_and_know_their_categories(spark):
    topics = spark.createDataFrame([("p", 1, ["invoice"]), ("q", 2, ["invoice"]), ("q", 3, ["gone"])], "project_id string, topic_id int, keywords array<string>")
    pages = spark.createDataFrame([("p", 1, "https://x/vs/invoices", "Help", None, 50), ("q", 2, "https://y/invoice-guide", None, None, 900)], "project_id string, page_id int, url string, title string, meta string, word_count int")
    got = {(r.project_id, r.topic_id): (r.pages, r.coverage, r.categories) for r in signals.match_pages(topics, pages, ["project_id"]).collect()}
    assert got == {("p", 1): (1, 0.4, ["comparison", "faq"]), ("q", 2): (1, 1.0, [])}


def test_keyword_hits_equal_brute_force_with_one_and_with_many_automata(spark):
    import random

    r = random.Random(6)
    words = ["".join(r.choices("abé日 '", k=r.randrange(1, 5))) for _ in range(60)] + ["", None, "a", "aa", "aaa"]
    rows = [(i, "".join(r.choices("abé日 '", k=r.randrange(60)))) for i in range(80)] + [(80, None), (81, ""), (82, "a" * 50_000), (None, "aa")]
    frames = spark.createDataFrame(rows, "text_id int, text string").withColumn("keyword", F.lit("clash")), spark.createDataFrame([(w,) for w in words], "keyword string")
    want = sorted(((i, w) for i, t in rows for w in {w for w in words if w} if w in (t or "")), key=str)
    for most, some in ((1000, 1000), (7, 9)):
        assert sorted(map(tuple, keyword_hits(*frames, automaton_words=most, slice_texts=some).collect()), key=str) == want
    assert keyword_hits(frames[0], frames[1].limit(0)).count() == 0


def test_gaps_of_one_topic_are_one(spark):
    rows = [("p", 7, "2024-01-02", "weak_topic", "best crm invoice"), ("p", 3, "2024-01-02", "weak_topic", "invoice, CRM?"), ("p", 1, "2024-01-05", "weak_topic", "crm invoice crm"), ("p", 1, "2024-01-05", "missing_faq", "crm invoice crm"), ("q", 9, "2024-01-01", "weak_topic", "crm invoice"), ("p", 4, "2024-01-01", "weak_topic", "the best")]
    gaps = spark.createDataFrame(rows, "project_id string, prompt_id int, first_at string, gap_type string, t string")
    got = signals.distinct_gaps(gaps, N.normalized_topic(N.topic_label(F.col("t"))), ["first_at", "prompt_id"])
    assert sorted((r.project_id, r.topic, r.gap_type, r.prompt_id) for r in got.collect()) == [("p", "best the", "weak_topic", 4), ("p", "crm invoice", "missing_faq", 1), ("p", "crm invoice", "weak_topic", 3), ("q", "crm invoice", "weak_topic", 9)]


def test_needed_gap_follows_category_then_wording(spark):
    rows = [("alternative", "x"), ("product", "how to?"), ("industry", "x"), ("faq", "x"), ("recommendation", " How do I?"), ("recommendation", "Howard is"), ("discovery", "apps for teams"), ("recommendation", "apps for teams")]
    got = spark.createDataFrame(rows, "c string, t string").select(signals.needed_gap(F.col("c"), F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == ["missing_comparison", "missing_product_detail", "missing_use_case", "missing_faq", "missing_faq", None, "missing_use_case", None]


def test_answer_structure_latches_sources_and_counts_items(spark):
    text = "# Tools\n1. Acme\n- Globex\nplain\n## Sources\n1. https://g2.com\n# More\n* Initech"
    rows = texts.answer_lines(spark.createDataFrame([("r", text), ("n", None)], "response_id string, text string")).orderBy("line_no").collect()
    assert [(r.kind, r.item_no) for r in rows] == [("heading", None), ("item", 1), ("item", 2), ("paragraph", None), ("heading", None), ("source", 3), ("heading", None), ("item", 4)]


def test_mentions_are_whole_words(spark):
    answers = spark.createDataFrame([("r", "Acme is the best choice. Acmeville lacks roads.\nTry Big Co today.")], "response_id string, text string")
    names = spark.createDataFrame([("Acme",), ("Big Co",)], "name string")
    assert {(r.name, r.sentence_no, r.strength) for r in texts.name_mentions(answers, names).collect()} == {("Acme", 0, "strong"), ("Big Co", 2, "unknown")}


def test_near_duplicate_prompts(spark):
    rows = [(1, 1, "best crm tool"), (2, 1, "the best CRM tools?"), (3, 1, "cheapest crm"), (4, 2, "best crm tool"), (5, 1, "what is the"), (6, 1, "What is the?"), (7, 1, None)]
    found = texts.near_duplicate_prompts(spark.createDataFrame(rows, "prompt_id int, set_id int, text string"))
    assert {(r.a, r.b) for r in found.collect()} == {(1, 2), (5, 6)}


def test_sources_stay_unknown_on_ties_and_weak_evidence(spark):
    rows = [("reddit.com", "/"), ("plain.example", "/blog/a"), ("blog.plain.example", "/blog/a"), ("news.site.example", "/blog/x"), ("agency.gov.uk", "/")]
    found = {r.host: r.domain_type for r in texts.classify_sources(spark.createDataFrame(rows, "host string, path string")).collect()}
    assert found == {"reddit.com": "community", "plain.example": "unknown", "blog.plain.example": "blog", "news.site.example": "unknown", "agency.gov.uk": "government"}


PAGE = """<!doctype html><html lang=en><head><title> A &amp; B </title><meta name=description content="hello"><link rel=canonical href="https://x.example/p">
<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"Acme, Inc.","sameAs":["https://x.com/a"]},{"@type":"Product","name":""}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><a href=/n>nav</a></nav><h1>One</h1><h3>Deep</h3><p>Text <b>bold</b> rest.<p>More<h2>One</h2><img src=a.png><img data-src=b.png alt=""></body></html>"""


def test_page_facts(spark):
    pages = spark.createDataFrame([(1, "https://x.example/p", PAGE), (2, None, None)], "page_id bigint, url string, html string")
    facts = {r.page_id: r for r in parse_pages(pages).collect()}
    one, none = facts[1], facts[2]
    assert (one.title, one.lang, one.canonical, one.meta["description"], one.has_doctype) == ("A & B", "en", "https://x.example/p", "hello", True)
    assert [(h.level, h.text) for h in one.headings] == [(1, "One"), (3, "Deep"), (2, "One")]
    assert [(b.is_valid) for b in one.blocks] == [True, False]
    assert [(i.src, i.alt) for i in one.images] == [("a.png", None), ("b.png", "")]
    assert one.links[0].in_navigation and "nav" not in one.text and "Text bold rest." in one.text
    assert none.title is None and none.headings == [] and none.text == ""
    issues = site_audit.heading_issues(parse_pages(pages)).first()
    assert (issues.skipped, issues.repeated) == (1, 2)
    parents = {r.position: r.parent_position for r in site_audit.heading_parents(parse_pages(pages)).collect()}
    assert parents == {1: None, 2: 1, 3: 1}


def test_clean_site_scores_100(spark):
    found = spark.createDataFrame([("s", "noindex_pages", "info", "indexability", 5)], "site string, code string, severity string, category string, affected int")
    assert site_audit.health_score(found, F.lit(10)).first().score == 100.0
    worse = spark.createDataFrame([("s", "title_missing", "high", "metadata", 10), ("s", "description_missing", "medium", "metadata", 10)], found.schema)
    assert site_audit.health_score(worse, F.lit(10)).first().score == 85.0


def test_readiness_drops_what_does_not_apply(spark):
    null = F.lit(None).cast("double")
    assert spark.range(1).select(site_audit.readiness_score({"evidence": F.lit(0.5), "faq": null}).alias("x")).first().x == 50.0


def test_jsonld(spark):
    payload = '{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"Acme, Inc.","sameAs":["https://x.com/a"],"telephone":"1"},{"name":""}]}'
    rows = [(1, 0, payload), (2, 0, payload.replace('"1"', '"2"')), (3, 0, "{bad"), (4, 0, None), (5, 0, "[]"), (6, 0, '{"@type":"Thing"}')]
    blocks = spark.createDataFrame(rows, "page_id bigint, block int, payload string")
    found = entities.extract_entities(blocks).collect()
    assert {(r.page_id, r.fingerprint, r.json_path) for r in found if r.entity_type == "Organization"} == {(1, "Organization|acme", "@graph[0]"), (2, "Organization|acme", "@graph[0]")}
    assert [(r.fingerprint, r.property, r["values"]) for r in entities.conflicts(entities.extract_entities(blocks)).collect()] == [("Organization|acme", "telephone", 2)]
    issues = {(r.page_id, r.code) for r in entities.validate_blocks(blocks).collect()}
    assert {(1, "empty_value"), (1, "missing_type"), (3, "invalid_json"), (4, "invalid_json"), (5, "empty_block"), (6, "missing_context")} <= issues
    pages = spark.createDataFrame([("acme.example", 1, "https://acme.example/"), ("acme.example", 2, "https://acme.example/about"), ("other.example", 6, "https://other.example/")], "site string, page_id bigint, url string")
    assert [(r.site, r.name, r.named, r.same_as) for r in entities.organization(entities.extract_entities(blocks), pages).collect()] == [("acme.example", "Acme, Inc.", 1, ["https://x.com/a"])]


@pytest.mark.parametrize("cadence, weekday, now, expected", [("daily", None, "2024-01-01 10:00:00", "2024-01-02 09:00:00"), ("daily", None, "2024-01-01 08:59:59", "2024-01-01 09:00:00"), ("weekly", 0, "2024-01-01 09:00:00", "2024-01-08 09:00:00"), ("weekly", 2, "2024-01-01 10:00:00", "2024-01-03 09:00:00")])
def test_next_run(spark, cadence, weekday, now, expected):
    at = operations.next_run(F.lit(cadence), F.lit(9), F.lit(weekday).cast("int"), F.lit(now).cast("timestamp"))
    assert str(spark.range(1).select(at.cast("string").alias("x")).first().x) == expected


def test_discovered_names(spark):
    text = "# Options\n1. Globex: a rival of Acme\n2. **Initech** - fine\nAlternatives to Acme include Hooli, Big Co and the best.\nVandelay vs Globex is close.\n## Sources\n1. Wikipedia"
    answers = spark.createDataFrame([("r", text), ("e", ""), ("n", None)], "response_id string, text string")
    known = spark.createDataFrame([("ACME",)], "name string")
    found = {r.name: (r.language, r.position) for r in texts.discovered_names(answers, known).collect()}
    assert found == {"Globex": (True, 1), "Initech": (False, 2), "Hooli": (True, None), "Big Co": (True, None), "Vandelay": (True, None)}
