"""The n-gram join against brute force: near copies, chains, repeated rows, long texts, several block sizes."""

import random

import pytest
from pyspark.sql import functions as F

from brandlens.llm import near_duplicates
from brandlens.llm.text_arrays import shingle_sets


def brute(texts):
    sets = [set(s.tolist()) for s in shingle_sets(texts)]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    sizes = {}
    for i in range(len(texts)):
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    return [(i, find(i), links[i], sizes[find(i)]) for i in range(len(texts))]


def texts_of_all_kinds():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    base, stream = [word() for _ in range(200)], [word() for _ in range(1500)]
    out = []
    for _ in range(120):  # near copies of one text, all of them different
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(200)] = word()
        out.append(" ".join(copy))
    out += [" ".join(stream[k * 8 : k * 8 + 160]) for k in range(60)]  # a chain: only neighbours are alike
    out += [" ".join(base[:50] + [word() for _ in range(150)]) for _ in range(40)]  # a shared passage links nothing
    out += [out[0]] * 20 + ["", None, "a b", "A  b!", "!!!", None, " ".join(word() for _ in range(30_000))]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    texts = texts_of_all_kinds()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("node", F.lit("clash")).withColumn("_k1", F.lit(None).cast("string"))
    got = near_duplicates.near_duplicate_classes(docs).select("doc_id", "class_id", "n_links", "class_size").collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_blocks_are_bounded_in_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 500)
    texts = texts_of_all_kinds()[:120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = near_duplicates.near_duplicate_classes(docs).select("doc_id", "class_id", "n_links", "class_size").collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_many_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.range(5000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(text).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    docs = rows.unionByName(spark.createDataFrame([(8, "another text of other words here", "a"), (9, text + " more", "a"), (None, text, "b"), (None, None, None)], "doc_id bigint, text string, source string"))
    facts = near_duplicates.near_duplicate_classes(docs).groupBy("doc_id", "class_id", "n_links", "class_size").count().collect()
    assert sorted(map(str, (tuple(r) for r in facts))) == sorted(map(str, [(7, 7, 5001, 5002, 5000), (8, 8, 0, 1, 1), (9, 7, 5001, 5002, 1), (None, 7, 5001, 5002, 1), (None, None, 0, 1, 1)]))
    # of repeated rows the one with the least other columns stays, whatever the order of the rows
    for frame in (docs, docs.repartition(5)):
        kept = near_duplicates.keep_one_of_each_class(frame).collect()
        assert sorted(map(str, ((r.doc_id, r.source) for r in kept))) == sorted(map(str, [(7, "s0"), (8, "a"), (None, None)]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates.near_duplicate_classes(docs).count() == 0
    assert near_duplicates.keep_one_of_each_class(docs).count() == 0
