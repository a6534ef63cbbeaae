"""References of structured data: nested, by id across pages, chains, cycles, rebuilt by version."""

import json

import pytest

from brandlens.operators import entity_graph as G

BLOCKS = "site string, page_id bigint, url string, block int, payload string"


def resolved(spark, rows):
    blocks = spark.createDataFrame([(s, p, u, b, x if isinstance(x, str) or x is None else json.dumps(x)) for s, p, u, b, x in rows], BLOCKS)
    return {(r.page_id, r.json_path, r.property, r.target_id): r for r in G.resolve_references(G.entity_nodes(blocks)).collect()}


def test_nested_and_cross_page_references(spark):
    got = resolved(
        spark,
        [
            ("x", 1, "https://x/a", 0, {"@graph": [{"@type": "Article", "author": {"@type": "Person", "name": "Ann"}, "publisher": {"@id": "/#org"}, "about": [{"@id": "#gone"}, {"@id": "#me"}]}, {"@id": "#me", "@type": "Thing"}]}),
            ("x", 2, "https://x/", 0, {"@type": "Organization", "@id": "#org", "name": "X Inc", "sameAs": ["https://social/x", ""]}),
            ("x", 3, "https://x/b", 1, [{"@type": "Organization", "@id": "https://x/#org"}, 7, None]),
            ("y", 4, "https://y/", 0, {"@type": "Article", "publisher": {"@id": "https://x/#org"}}),
            ("y", 5, "https://y/", 0, "{broken"),
            ("y", 6, None, 0, None),
        ],
    )
    org = got[1, "@graph[0]", "publisher", "https://x/#org"]
    assert (org.resolved, org.target_page_id, org.target_type, org.target_name) == (True, 2, "Organization", "X Inc")
    author = got[1, "@graph[0]", "author", None]
    assert (author.target_page_id, author.target_path, author.target_name) == (1, "@graph[0].author", "Ann")
    assert not got[1, "@graph[0]", "about", "https://x/a#gone"].resolved
    assert got[1, "@graph[0]", "about", "https://x/a#me"].target_path == "@graph[1]"
    assert not got[4, "", "publisher", "https://x/#org"].resolved  # another site's ids mean nothing here
    assert len(got) == 5  # no row for the link to another address


def test_chains_and_cycles_end_in_one_id(spark):
    def same(i, *targets):
        return {"@type": "Thing", "@id": f"https://x/#{i}", "sameAs": [{"@id": f"https://x/#{t}"} for t in targets]}

    chain = [same(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [{"@type": "Organization", "@id": "https://x/#c20", "name": "End"}]
    cycle = [same("k3", "k1"), same("k1", "k2"), same("k2", "k3"), same("a-tail", "k2"), same("self", "self"), same("two", "k9", "k1")]
    used = [{"@type": "Article", "about": [{"@id": f"https://x/#{i}"} for i in ("c00", "c07", "c20", "k1", "k2", "k3", "a-tail", "self", "two")]}]
    got = resolved(spark, [("x", 1, "https://x/", 0, chain), ("x", 2, "https://x/k", 0, cycle), ("x", 3, "https://x/u", 0, used), ("y", 9, "https://x/", 0, chain[:3])])
    meant = {r.target_id.split("#")[1]: (r.canonical_id.split("#")[1], r.target_name) for r in got.values() if r.property == "about"}
    assert meant == {"c00": ("c20", "End"), "c07": ("c20", "End"), "c20": ("c20", "End"), "k1": ("k1", None), "k2": ("k1", None), "k3": ("k1", None), "a-tail": ("k1", None), "self": ("self", None), "two": ("k1", None)}
    assert got[9, "[0]", "sameAs", "https://x/#c01"].canonical_id == "https://x/#c02"


@pytest.mark.parametrize("rows", [[], [("s", "a", "a")]])
def test_no_aliases(spark, rows):
    assert G.canonical_ids(spark.createDataFrame(rows, "site string, id string, target string")).collect() == []


def test_rebuild_takes_the_latest_version_and_nothing_else(spark):
    def html(*payloads):
        return "".join(f'<script type="application/ld+json">{json.dumps(x) if not isinstance(x, str) else x}</script>' for x in payloads)

    org = {"@context": "https://schema.org", "@type": "Organization", "@id": "https://x/#org", "name": "X"}
    versions = [
        ("x", 1, "https://x/", html(org, {**org, "telephone": "1"}, "{bad"), "2024-01-02"),
        ("x", 1, "https://x/", html({**org, "name": "Old"}), "2024-01-01"),
        ("x", 2, "https://x/b", html({"@context": "https://schema.org", "@type": "Article", "publisher": {"@id": "https://x/#org"}}, {**org, "telephone": "2"}), "2024-01-01"),
        ("x", 3, "https://x/c", None, "2024-01-01"),
    ]
    t = G.rebuild(spark.createDataFrame(versions, "site string, page_id bigint, url string, html string, crawled_at string"))
    assert {r.name for r in t.entities.collect()} == {"X", None}
    assert [(r.page_id, r.target_name, r.target_page_id) for r in t.references.collect()] == [(2, "X", 1)]
    assert [(r.page_id, r.code) for r in t.issues.collect()] == [(1, "invalid_json")]
    assert [(r.property, r["values"], r.pages) for r in t.conflicts.collect()] == [("telephone", 2, 2)]
    assert [(r.fingerprint, r.page_id, r.occurrences) for r in t.duplicates.collect()] == [("Organization|x", 1, 2)]
    assert {r.page_id: [[(x.property, x.target_name) for x in e.refs] for e in r.entities] for r in t.pages.collect()} == {1: [[], []], 2: [[("publisher", "X")], []], 3: []}
