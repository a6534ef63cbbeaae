"""Mixing, HTML, chats, URLs, searches and the pipeline: properties, brute force and edge cases."""

import hashlib
import importlib.util
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brandlens.llm import ann, chat_format, exact_topk, html_text, source_mix, url_filter, vectors
from brandlens.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(str, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


# ---- mixing -------------------------------------------------------------------------------------------------------


def mixed(spark, counts, **kw):
    rows = [(i, s) for s, n in counts.items() for i in range(hash(s) % 7, hash(s) % 7 + n)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("mix_slot", F.lit("clash"))
    return source_mix.mix_sources(frame, **kw).collect(), len(rows)


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.11, "b": 0.61, None: 0.28}])
def test_every_source_stays_within_one_block_of_its_share(spark, weights):
    cycle, block = 50, 2
    out, n = mixed(spark, {"a": 400, "b": 130, "c": 57, None: 31}, weights=weights, cycle=cycle, block_rows=block)
    assert len(out) == n and len({r.mix_position for r in out}) == n
    blocks = {}
    for r in out:
        blocks.setdefault((r.mix_source_no, r.mix_block), r.mix_slot)
    by_source = {}
    for (s, _), slot in blocks.items():
        by_source.setdefault(s, []).append(slot)
    quota = {s: sum(1 for x in slots if x < cycle) for s, slots in by_source.items()}
    full = {s: len(slots) >= quota[s] and max(slots) >= cycle for s, slots in by_source.items()}
    for s, slots in by_source.items():
        if not full[s]:
            continue
        slots = sorted(slots)
        share = quota[s] / cycle
        for t in range(max(slots) + 1):
            served = sum(1 for x in slots if x < t)
            assert abs(served - share * t) < 1


def test_schedule_meets_releases_and_deadlines(spark):
    quotas = spark.createDataFrame([(1, 7), (2, 2), (3, 1)], "source_no int, quota int")
    plan = source_mix.cycle_schedule(quotas, 10).collect()
    a = {1: 7, 2: 2, 3: 1}
    assert sorted(r.slot for r in plan) == list(range(10))
    for r in plan:
        j = r.block_in_cycle + 1
        assert (j - 1) * 10 // a[r.source_no] <= r.slot < math.ceil(j * 10 / a[r.source_no])


def test_mixing_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, source string")
    assert source_mix.mix_sources(empty).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None)] + [(i, f"s{i}") for i in range(30)]
    out = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), max_sources=5, block_rows=1).collect()
    assert len(out) == len(rows) == len({r.mix_position for r in out})
    assert len({r.mix_source_no for r in out}) == 6


# ---- chats --------------------------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    nasty = "<|end|><|next|>&amp;&lt;[INST]</s>|>\\&bar;\n<|assistant|>"
    rows = [(1, 0, "user", nasty), (1, 1, "user", ""), (1, 2, "assistant", nasty), (1, 3, "assistant", None), (1, 4, "as|>sis<", "x"), (2, 5, None, "a"), (2, 5, None, "a"), (None, None, "assistant", "👍é"), (3, 2, "assistant", "b"), (3, 1, "user", "a" * 100000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    chats = chat_format.format_chats(frame)
    read = chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in read.collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("user", nasty), ("user", ""), ("assistant", nasty), ("assistant", ""), ("as|>sis<", "x")]
    assert got[1].loss == nasty and got[None].loss == "👍é"
    assert [(t.role, t.text) for t in got[2].t] == [("", "a"), ("", "a")]
    assert [t.role for t in got[3].t] == ["user", "assistant"]
    assert "</s>" not in got[1].formatted and "[INST]" not in got[1].formatted
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_op4_has_the_planted_conversation(spark):
    row = QUERIES["op4_chat_formatting"](spark, DATA).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


# ---- URLs ---------------------------------------------------------------------------------------------------------


def fits(glob, text):
    """Plain recursive matching."""
    if not glob:
        return not text
    if glob.startswith("**"):
        return fits(glob[2:], text) or (bool(text) and fits(glob, text[1:]))
    if glob[0] == "*":
        return fits(glob[1:], text) or (bool(text) and text[0] != "\0" and fits(glob, text[1:]))
    return bool(text) and text[0] == glob[0] and fits(glob[1:], text[1:])


def test_automaton_against_plain_matching():
    r = random.Random(4)
    globs = ["".join(r.choice(["a", "b", "*", "**", "\0", "ab"]) for _ in range(r.randint(0, 9))) for _ in range(60)]
    texts = ["".join(r.choice("ab\0") for _ in range(r.randint(0, 12))) for _ in range(200)]
    got = url_filter.Automaton(globs).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            assert got[i, k] == fits(g, t), (g, t)


URLS = {
    "https://EXAMPLE.org/es/x": ("example.org", "/es/x", "example.org/es/", "block"),
    "https://a.example.org/en/1?q": ("a.example.org", "/en/1", "example.org/en/1", "block"),
    "https://a.example.org/en/2": ("a.example.org", "/en/2", "org/", "allow"),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
    "https://x.com": ("x.com", "", None, "allow"),
    "https://x.net/a.com/fr/": ("x.net", "/a.com/fr/", None, "allow"),
    "http://cheap-pills.example.net/": ("cheap-pills.example.net", "/", None, "block"),
    "no scheme": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://x.com/fr/" + "a" * 3000: ("x.com", "/fr/" + "a" * 3000, "com/fr/", "allow"),
}


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, next(iter(URLS)), "clash")], "page_id bigint, url string, host string")
    out = url_filter.judge_urls(frame).collect()
    assert len(out) == len(URLS) + 1
    expected = list(URLS.values())
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == expected[r.page_id]
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


# ---- HTML ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    return html_text.train_labeller()


def test_generated_pages_that_were_not_learnt(labeller):
    pages, labels = html_text.generated(150, seed=77)
    right = np.concatenate([(labeller.logits([p])[0] > 0) == (y > 0) for p, y in zip(pages, labels, strict=True)])
    assert right.mean() > 0.98


def test_gradients_against_finite_differences():
    pages, labels = html_text.generated(3, seed=3)
    model = html_text.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        total = count = 0.0
        for z, y in zip(model.logits(pages), labels, strict=True):
            total += np.sum(np.logaddexp(0, z) - y * z)
            count += len(y)
        return total / count

    grad = model.gradients(pages, labels)
    rng = np.random.default_rng(0)
    for name in ("xf", "hf", "hb", "cb", "o", "path"):
        flat, g = model.p[name].reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(g) > np.abs(g).max() / 10), 3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-3 == pytest.approx(g[i], rel=0.1, abs=2e-5)


HTML = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Real &amp; true</h1><p>First   <b>bold</b> words are here, and they go on for a while.<br>Second line of it.<p>Another paragraph of the article, with more to say.</p></article>
<aside class="sidebar"><h3>Related</h3><a href=/c>Other story</a></aside><section id="comments"><h2>Comments</h2><div class="comment"><p>I agree with this.</p></div></section>
<form class="newsletter"><label>Email</label><button>Send</button></form><footer>&copy; 2024 All rights reserved.</footer></body></html>"""


def test_article_without_the_rest(spark, labeller):
    rows = [(1, "u", HTML), (1, "u", HTML), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 300 + "x" + "<" * 20), (None, "u", "<!-- open"), (5, "u", "plain &#x41; text")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract_text(frame, labeller)
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == ["Real & true First bold words are here, and they go on for a while. Second line of it. Another paragraph of the article, with more to say."] * 2
    assert got[2] == got[3] == got[None] == [""]
    assert html_text.extract_text(frame.limit(0), labeller).count() == 0


def test_op3_finds_the_articles(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    right = 0
    for r in QUERIES["op3_html_extraction"](spark, DATA).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        right += r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r.n_chars == len(r.text)
    assert right >= 0.96 * len(pages)


# ---- searches -----------------------------------------------------------------------------------------------------


def brute(rows, k, score):
    out = []
    for own, (q, a) in enumerate(rows):
        if q % 50 == 0:
            found = sorted(((-score(a, b), c) for other, (c, b) in enumerate(rows) if other != own and len(a) == len(b)))[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("vector", F.lit("clash"))


@pytest.mark.parametrize("n, ties", [(400, False), (400, True), (4, False), (1, False)])
def test_exact_search_equals_brute_force(spark, monkeypatch, n, ties):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(exact_topk, "BLOCK_QUERIES", 3)
    r = np.random.default_rng(n)
    rows = [(i, (np.ones(8) if ties and i % 3 else r.normal(0, 0.3, 8)).astype(np.float32).tolist()) for i in range(n)]
    odd = [(1001, None), (1050, []), (1100, [1.0, None] + [0.0] * 6), (1150, [float("nan")] * 8), (1200, [float("inf")] * 8), (None, [0.1] * 8)] if n > 1 else []
    rows += rows[:3]  # repeated rows are candidates like any other
    whole = exact_topk.whole_vectors(vectors.usable_vectors(table(spark, rows + odd)))
    got = exact_topk.top_k(whole, whole.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5)
    ints = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(ints, 5, lambda a, b: int(a @ b))


def test_exact_search_of_nothing(spark):
    empty = table(spark, []).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    assert exact_topk.top_k(empty, empty.withColumnRenamed("vec_id", "query_id")).count() == 0
    assert ann.nearest(empty, empty.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_few_vectors_are_searched_whole(spark):
    r = np.random.default_rng(1)
    rows = [(i, (np.ones(8) if i % 3 == 0 else r.normal(0, 1, 8)).astype(np.float32).tolist()) for i in range(120)] + [(500, [0.0] * 8), (501, [1.0, 2.0])]
    usable = vectors.usable_vectors(table(spark, rows)).where(F.exists("vector", lambda x: x != 0))
    got = ann.nearest(usable, usable.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")).collect()
    full = [(i, np.array(v)) for i, v in rows[:120]]
    expected = brute(full, 5, lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [x[:3] for x in expected]


def test_learned_partitions_reach_the_recall(spark):
    r = np.random.default_rng(2)
    centres = r.normal(0, 1, (40, 24))
    x = centres[r.integers(0, 40, 4000)] + r.normal(0, 0.35, (4000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, vector array<double>")
    got = ann.nearest(frame, frame.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), parts=16, sample_rows=4096).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for row in got:
        found.setdefault(row.query_id, set()).add(row.vec_id)
        assert row.score == pytest.approx(float(unit[row.query_id] @ unit[row.vec_id]), abs=1e-12)
    hits = []
    for q in range(0, 4000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits.append(len(found[q] & set(np.argsort(-s)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.9


# ---- pipeline -----------------------------------------------------------------------------------------------------


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is absent")
def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    from brandlens.llm.language_id import predict_language, train_language_model
    from brandlens.llm.text_arrays import shingle_sets
    from brandlens.llm.toxicity import score_toxicity, train_toxicity_model

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [r for r in predict_language(docs, train_language_model(docs)).collect() if r.lang_pred != "und" and r.lang_score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    left = spark.createDataFrame([(r.doc_id, r.text, r.lang_pred, r.source, r.n_chars) for r in kept], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = train_toxicity_model(left, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = sorted((r for r in score_toxicity(left, model).collect() if r.toxic_score < 0.5), key=lambda r: r.doc_id)
    sets = [set(s.tolist()) for s in shingle_sets([r.text for r in clean])]
    root = list(range(len(clean)))
    for _ in range(4):
        for i in range(len(clean)):
            for j in range(i):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    expected = {clean[i].doc_id: clean[i].text for i in range(len(clean)) if root[i] == i}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(expected)
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256((expected[r.doc_id] or "").encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is absent")
def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
