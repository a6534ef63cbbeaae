"""What the review of the first round found missing."""

import html

from brandlens.plans import registry

DATA = "/root/testdata/sf0.001"


def test_verification_reads_every_event(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").collect()
    seen = {}
    for r in events:
        seen.setdefault((r.event_type, f"u{r.user_id}/{r.ts.hour}" if r.user_id % 5 else None), set()).add(r.ts.day > 15)
    state = {key: "awaiting" if len(x) == 2 else "new" if True in x else "verified" for key, x in seen.items()}
    out = registry.QUERIES["audit_verification_all"](spark, DATA).collect()
    assert len(out) == len(state) and {(r.code, r.url): r.state for r in out} == state
    assert set(state.values()) == {"awaiting", "new", "verified"}


def test_titles_with_cut_references(spark, tmp_path):
    titles = ["AT&T news", "R&D jobs", "Fish &amp Chips", "Cut &lt", "A &amp; B", "Caf&eacute; &unknown; x", "plain"]
    rows = [(i, f"https://a.example/{i}", f"<!doctype html><html><head><title>{t}</title></head><body><h1>x</h1></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r.page_id: r.title for r in registry.QUERIES["page_titles_all"](spark, str(tmp_path)).collect()}
    assert out == {i: html.unescape(t) for i, t in enumerate(titles)}
