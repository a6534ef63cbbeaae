"""Language, toxicity, BPE and near-duplicates: brute force, round trips, held-out accuracy and edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brandlens.llm import byte_bpe, language_id, near_duplicates, toxicity
from brandlens.llm.text_arrays import shingle_sets, words

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---- byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = []
    for ids, counts in byte_bpe.encode_texts(texts, ranks, public_tokenizers.PATTERN):
        ends = np.cumsum(counts)
        out += [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab =-\n\té漢👍1", max_size=80)), max_size=5))
def test_ids_are_those_of_the_public_library(texts):
    ranks = tiktoken_reference()
    assert encoded(texts) == [ranks.encode_ordinary(t) for t in texts]


_cache = []


def tiktoken_reference():
    if not _cache:
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cache.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _cache[0]


def test_long_runs(reference):
    texts = ["a" * 3000, " " * 1000 + "x", "=-" * 1500, "aaab" * 700, "", None]
    assert encoded(texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_op6_whole_table_against_the_public_library(spark, docs, reference):
    from brandlens.llm.registry import QUERIES

    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = QUERIES["op6_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_edge_cases(spark):
    rows = [(1, "hello world", "x", 7), (1, "hello world", "x", 7), (2, None, None, 7), (None, "", "x", 7), (3, "ü" * 50000, "x", 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, other int")
    out = byte_bpe.digests(byte_bpe.round_trip_bpe(frame)).collect()
    apart = byte_bpe.digests(byte_bpe.decode_bpe(byte_bpe.encode_bpe(frame))).collect()
    assert sorted(map(str, out)) == sorted(map(str, apart))
    assert len(out) == 5
    assert {r.doc_id: r.n_tokens for r in out}[2] == 0 and {r.doc_id: r.n_tokens for r in out}[None] == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.decoded_sha256 for r in out if r.n_tokens == 0} == {empty}
    assert byte_bpe.round_trip_bpe(frame.limit(0)).count() == 0


# ---- language -----------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, docs):
    from brandlens.llm.registry import QUERIES

    out = QUERIES["op2_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_cases(spark, docs):
    model = language_id.train_language_model(docs)
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 ...", None), (4, "Ça", "a"), (4, "Ça", "a"), (None, "the and of " * 20000, "a")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, LANG_PRED string")
    out = language_id.predict_language(frame, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "lang_score"]
    got = {(r.doc_id, r.text and r.text[:3]): (r.lang_pred, r.lang_score) for r in out.collect()}
    assert got[(1, None)] == got[(2, "")] == got[(3, "123")] == ("und", 0.0)
    assert got[(None, "the")][0] == "en"
    assert language_id.predict_language(frame.limit(0), model).count() == 0
    assert language_id.train_language_model(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict_language(frame, None).collect()} == {"und"}


def test_scores_fold_the_landmarks_exactly(docs):
    rows = docs.where("doc_id < 60").collect()
    bits = np.concatenate([b for b, _ in language_id.presence([r.text for r in rows])])
    model = language_id.fit_kernel_ridge(np.packbits(bits, axis=1), [r.lang for r in rows], landmarks=16)
    phi = language_id.normalised(bits)
    chosen = np.concatenate([np.flatnonzero(np.array([r.lang for r in rows]) == c)[: 16 // len(model.languages)] for c in model.languages])
    kernel = phi @ phi[chosen].T
    # the folded score is linear in the kernel values of the landmarks
    solved, *_ = np.linalg.lstsq(np.hstack([kernel, np.ones((len(kernel), 1))]), model.scores(bits), rcond=None)
    assert np.allclose(np.hstack([kernel, np.ones((len(kernel), 1))]) @ solved, model.scores(bits), atol=1e-3)


# ---- toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    from brandlens.llm.registry import QUERIES

    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    out = QUERIES["op8_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    assert np.mean(np.array(toxic)[:, None] > np.array(clean)[None, :]) > 0.95
    assert np.mean([s >= 0.5 for s in toxic]) > 0.8 and np.mean([s >= 0.5 for s in clean]) < 0.01
    assert all(r.predicted == int(r.score >= 0.5) for r in out)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, "you idiot " * 3 + f"w{i}" if i % 2 else f"nice day w{i}", 1.0) for i in range(1, 60)] + [(100, None, 1.0), (101, "", 1.0), (None, "idiot", 1.0)], "doc_id bigint, text string, Toxic_Score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity_model(docs, labels)
    out = {(r.doc_id, r.text): r.toxic_score for r in toxicity.score_toxicity(docs, model).collect()}
    assert out[(100, None)] == out[(101, "")]
    assert all(0 <= s <= 1 for s in out.values())
    empty = toxicity.train_toxicity_model(docs.limit(0), labels.limit(0))
    assert all(r.toxic_score < 0.5 for r in toxicity.score_toxicity(docs, empty).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_l1_leaves_few_weights():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 5000, 80), [i % 2] * 1)) for i in range(400)]
    model = toxicity.fit_ftrl(rows, np.array([float(i % 2 == 0) for i in range(400)]), 0.5)
    assert len(model.index) < 600 and model.table()[0] > 0 > model.table()[1]


# ---- near-duplicates ----------------------------------------------------------------------------------------------


def brute(rows):
    """class and number of links of every row, over all pairs."""
    sets = [set(s.tolist()) for s in shingle_sets([r[1] for r in rows])]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    members = {}
    for i in range(n):
        members.setdefault(root[i], []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted((rows[i][0] if rows[i][0] is not None else -1, least[root[i]] if least[root[i]] is not None else -1, sum(link[i])) for i in range(n))


def near_rows(seed, groups=6, size=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(4, 90))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
    return rows + [(k, None), (k + 1, ""), (k + 2, "!!!"), (k + 3, "one two"), (k + 4, "One, two!"), (0, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_links_equal_brute_force(spark, seed):
    rows = near_rows(seed)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash"))
    out = near_duplicates.near_duplicate_classes(frame).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == brute(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = near_rows(3, groups=2, size=30)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    out = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == brute(rows)


def test_one_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, text.replace("w7 ", "x "), "c"), (1, "other words are here today", "d"), (None, text, "e"), (2, None, "f"), (4, None, "g")]
    kept = near_duplicates.keep_one_of_each_class(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((r.doc_id, r.source) for r in kept.collect()) == [(1, "d"), (2, "f"), (3, "b"), (4, "g")]
    assert near_duplicates.near_duplicate_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_bands_reach_the_recall():
    bands, rows = near_duplicates.bands_for(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= near_duplicates.RECALL and bands * rows <= near_duplicates.MOST_HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100 + i, 150) for i in range(30)] + [(7, 7)]
    found = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {found[i] for i in range(21)} == {0} and {found[100 + i] for i in range(30)} | {found[150]} == {100}


@given(st.lists(st.text(alphabet="abc _1é\n", max_size=40), max_size=4))
@settings(max_examples=100, deadline=None)
def test_words_are_runs_of_word_characters(texts):
    import re

    low = [t.lower() for t in texts]
    hashes, owner = words(low)
    expected = [(i, w) for i, t in enumerate(low) for w in re.findall(r"\w+", t)]
    assert owner.tolist() == [i for i, _ in expected]
    seen = {}
    for h, (_, w) in zip(hashes.tolist(), expected, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
