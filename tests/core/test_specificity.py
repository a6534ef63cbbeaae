"""Specific sentences against a plain reading, with the names of each site."""

import re

from pyspark.sql import functions as F

from brandlens.operators import specificity as S
from brandlens.operators.site_audit import SIGNALS


def plain(text, names):
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if len(s.split()) >= 4]
    number = re.compile(r"(?<![\w.])\d[\d,.]*(?:%|[kKmMbB])?(?![\w.])")
    date = re.compile(S.DATE.removeprefix("(?i)"), re.I)
    hit = [s for s in sentences if number.search(s) or date.search(s) or any(len(n) >= 3 and n.lower() in s.lower() for n in names)]
    return len(sentences), len(hit)


TEXT = "Initech shipped Gadget in April 2020. It handles 3,000 orders each hour. We enjoy building things. The whole crew is kind and cheerful to all."


def test_share_with_and_without_site_names(spark):
    texts = {
        ("a", 1): TEXT,
        ("a", 2): "Our gadgetry is quite good.\nVersion v2.0 is not a number here! But 20% more of it is.",
        ("b", 3): "Acme is not known on this site.\nAc is too short a name. Globex Café sells things here",
        ("b", 4): None,
        ("b", 5): "Too short. No. " * 3,
        ("c", 6): "Released on 2024-01-31 for all people. Or on 1/2/2023, so they say.",
    }
    names = {"a": ["Gadget", "Initech"], "b": ["Globex Café", "Ac", "ac"], "gone": ["Acme"]}
    pages = spark.createDataFrame([(s, p, t) for (s, p), t in texts.items()], "site string, page_id bigint, text string")
    named = spark.createDataFrame([(s, n) for s, ns in names.items() for n in ns], "site string, name string")
    got = {(r.page_id): (r.sentences, r.specific) for r in S.specific_shares(pages, named).collect()}
    assert got == {p: plain(t, names.get(s, [])) for (s, p), t in texts.items()}
    assert got[1] == (4, 2)
    assert {r.page_id: (r.sentences, r.specific) for r in S.specific_shares(pages).collect()} == {p: plain(t, []) for (s, p), t in texts.items()}
    assert {r.page_id: r.specific_share for r in S.specific_shares(pages, named).collect()}[4] == 0.0


def test_names_come_from_products_and_the_organization(spark):
    entities = spark.createDataFrame([(1, "Product", "Widget"), (1, "Product", None), (2, "Service", "Care"), (2, "Person", "Ann")], "page_id bigint, entity_type string, name string")
    pages = spark.createDataFrame([("a", 1), ("b", 2)], "site string, page_id bigint")
    got = S.site_names(entities, pages, spark.createDataFrame([("a", "Acme"), ("c", None)], "site string, name string"))
    assert sorted(map(tuple, got.collect())) == [("a", "Acme"), ("a", "Widget"), ("b", "Care")]


def test_prices_and_addresses(spark):
    rows = [("49 USD", True), ("10/mo", True), ("€ 5", True), ("per seat", True), ("5 apples", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(F.col("t").rlike(SIGNALS["pricing"]).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    assert spark.range(1).select(F.lit("221 Baker Street").rlike(SIGNALS["postal_address"]).alias("x")).first().x
