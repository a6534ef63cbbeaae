"""Context-tree scores, the filter audit and collocations against brute force; nulls, ties, repeated rows, long texts, empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from brandlens.llm import collocations, context_tree, filter_audit

SCHEMA = "doc_id bigint, text string, lang string, source string"


# context trees


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


class Tree:
    """One dictionary of counts, weighted by plain recursion."""

    def __init__(self, depth):
        self.depth, self.counts, self.children, self.memo = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}

    def paths(self, data):
        padded = b"\xff" * self.depth + data
        for i in range(self.depth, len(padded)):
            before = 1
            for j in range(7, -1, -1):
                bit = padded[i] >> j & 1
                yield [(padded[i - d : i], before) for d in range(self.depth + 1)], bit
                before = before * 2 + bit

    def learn(self, data):
        for path, bit in self.paths(data):
            for node, child in zip(path, [*path[1:], None]):
                self.counts[node][bit] += 1
                if child:
                    self.children[node].add(child)

    def weighted(self, node):
        if node not in self.memo:
            own = kt(*self.counts[node])
            if len(node[0]) < self.depth:
                below = sum(self.weighted(c) for c in self.children[node])
                high = max(own, below)
                own, stop = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2), own - math.log(2)
                self.memo[node] = own, math.exp(stop - own)
            else:
                self.memo[node] = own, 1.0
        return self.memo[node][0]

    def chance(self, path, bit):
        known = [n for n in path if n in self.counts]
        out = 0.5
        for node in reversed(known):
            self.weighted(node)
            own = (self.counts[node][bit] + 0.5) / (sum(self.counts[node]) + 1)
            out = own if node is known[-1] else self.memo[node][1] * own + (1 - self.memo[node][1]) * out
        return out

    def score(self, data):
        return sum(math.log10(self.chance(path, bit)) for path, bit in self.paths(data))


def held(doc, mod):
    return doc is not None and zlib.crc32(str(doc).encode()) % mod == 0


def plain_scores(rows, depth):
    split = [(doc, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for doc, text in rows]
    tree, counts = Tree(depth), Counter()
    for doc, words in split:
        if not held(doc, 10):
            tree.learn(" ".join(words).encode() + b"\xff")
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, words in split:
        data = " ".join(words).encode() + b"\xff"
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, None])
        out.append((doc, held(doc, 10), len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), n, base, tree.score(data)))
    return out


def some_texts():
    r = random.Random(5)
    words = ["the", "The", "cat", "Ärger", "日本", "mat mat", "x" * 40, "ab", "abc", "don't"]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 30))) for _ in range(60)]
    return [*enumerate(texts), (60, None), (61, ""), (62, " \t\n\x0b\x0c\r "), (None, "no id at all"), (5, texts[5]), (5, texts[5]), (63, " a\x1cb  the \n cat ")]


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-8, abs=1e-7)


def scored(docs, **options):
    return [tuple(r)[:7] for r in context_tree.score_texts(docs, **options).collect()]


@pytest.mark.parametrize(("depth", "block", "piece", "bucket"), [(5, 16 << 20, 1 << 20, 1 << 20), (4, 500, 100, 700), (2, 200, 40, 900), (0, 64, 64, 2000)])
def test_scores_equal_plain_context_trees(spark, monkeypatch, depth, block, piece, bucket):
    monkeypatch.setattr(context_tree, "GROUP_GRAMS", 100)
    rows = some_texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit("clash")).withColumn("gram", F.lit(None).cast("string")).repartition(3)
    same_scores(scored(docs, depth=depth, block_bytes=block, piece_bytes=piece, bucket_bytes=bucket), plain_scores(rows, depth))


@pytest.mark.parametrize("depth", range(7))
def test_words_and_grams_of_a_block_equal_plain_loops(depth):
    r = random.Random(depth)
    texts = [b" ".join(r.choices([b"a", b"\xc3\xa9", b"bc", b"q" * 50], k=r.randrange(9))) + context_tree.END for _ in range(60)]
    heads, bodies = zip(*[x for t in texts for x in context_tree.pieces(t, depth, 20)], strict=True)
    learnt = [r.random() < 0.5 for _ in bodies]
    words, begin, number, many = context_tree.numbered_words(list(bodies), 3)
    plain = [(b[:-1].split() + [b""]) if b.endswith(context_tree.END) else b.split() for b in bodies]
    assert [words[i] for i in number] == [w for part in plain for w in part] and many.tolist() == [len(part) for part in plain]
    for k in range(3):
        assert words[begin[k] : begin[k + 1]] == sorted({w for part in plain for w in part if context_tree.word_bucket(w, 3) == k})
    counts = Counter()
    for head, body, own in zip(heads, bodies, learnt, strict=True):
        for i in range(len(body)):
            counts[int.from_bytes((head + body)[i : i + depth + 1], "big")] += own
    keys, n = context_tree.block_grams(list(heads), list(bodies), learnt, depth)
    assert list(zip(keys.tolist(), n.tolist(), strict=True)) == sorted(counts.items())


def test_scores_of_a_very_long_text_do_not_depend_on_its_pieces(spark):
    r = random.Random(8)
    rows = [(1, " ".join(f"w{r.randrange(3000)}" for _ in range(400_000))), (2, "w1 w2 unknown"), (3, "y" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    small, large = scored(docs, block_bytes=1 << 18, piece_bytes=1 << 14, bucket_bytes=1 << 20), scored(docs)
    same_scores(small, large)
    assert {r[0]: r[2] for r in large} == {1: 400_001, 2: 4, 3: 2}


def test_scores_of_an_empty_table_and_of_held_out_rows_alone(spark):
    assert scored(spark.createDataFrame([], "doc_id bigint, text string")) == []
    out = next(d for d in range(100) if held(d, 10))
    same_scores(scored(spark.createDataFrame([(out, "a b")], "doc_id bigint, text string")), plain_scores([(out, "a b")], 5))


def test_a_decision_has_two_outcomes_and_learnt_texts_beat_the_base(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r.score > r.base_score and r.bits_per_byte < 1 for r in context_tree.score_texts(docs).collect())


# filter audit


def plain_audit(docs, labels):
    by_id = defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        by_id[doc] = [max(by_id[doc][0], int(quality == 1)), max(by_id[doc][1], int(toxic == 1))]
    least = {}
    for doc, text, _, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    rows = []
    for doc, text, _, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {f for f, bad in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
                                   ("D", re.search(r"[#$%&*|]", text)), ("E", doc is not None and doc > least[text])) if bad}
        rows.append((source or "", failed, *(by_id[doc] if doc is not None else (0, 0))))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                all_failing = sum(1 for r in rows if r[0] == part and f in r[1])
                alone = sum(1 for r in rows if r[0] == part and r[1] == {f})
                shapley[part, f] += len(here)
                out[part, order, step] = [len(left), len(here), all_failing - len(here), alone, sum(r[2] for r in here), sum(r[3] for r in here)]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def audited_rows():
    r = random.Random(2)
    long_text = " ".join(f"w{i}" for i in range(80))
    kinds = [long_text, "SHOUT " * 60, "a $ b", "same " * 70, None, "", "ÄÖÜ " * 10, long_text + " & more", "B" + long_text]
    docs = [(i, r.choice(kinds), "en", r.choice(["s", "t", None, ""])) for i in range(200)]
    docs += [(i, long_text, None, "hot") for i in range(1000, 1600)]  # copies over many ranges
    docs += [(3, docs[3][1], "en", "s"), (3, docs[3][1], "en", "s"), (None, long_text, "en", "s"), (None, long_text, "en", "s"), (None, "alone", "en", "s"), (1700, "alone", "en", "s")]
    docs += [(1800, "very long " * 200_000, "en", "t"), (1801, "very long " * 200_000, "en", "t")]
    r.shuffle(docs)
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 1700, 3)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (99999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_audit_equals_brute_force(spark, partitions):
    docs, labels = audited_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(docs, SCHEMA).withColumn("part", F.lit("clash")).withColumn("mask", F.lit(7)).withColumn("print", F.lit(1)).repartition(5)
        got = filter_audit.audit_filters(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(1)))
        got = got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got)) == plain_audit(docs, labels)


def test_fingerprints_that_collide_are_told_apart(spark, monkeypatch):
    docs, labels = audited_rows()
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: F.lit(1).cast("bigint"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.audit_filters(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        got = got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got)) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "x", "en", "s")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).collect() == []
    assert filter_audit.audit_filters(some, labels).count() == 600


# collocations


def plain_collocations(docs, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, _ in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) >= 3 and a >= least}
    out = defaultdict(list)
    for p, a in found.items():
        lang, words = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(words)] == words for i in range(1, len(q))) for q, b in found.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def phrase_texts():
    r = random.Random(4)
    words = [*"abcdefgh", "Ärger", "日本", "New", "York", "x y", "\x1cq"]
    docs = []
    for i in range(150):
        body = []
        for _ in range(r.randrange(60)):
            body += r.choice([["New", "York", "city"], ["of", "the"], ["rock", "and", "roll", "band"], [r.choice(words)]])
            body.append(r.choice([" ", " ", " ", ", ", ".", "\t", "  ", "\n", "!?"]))
        docs.append((i, " ".join(body), r.choice(["en", "en", "de", None, "a\tb"]), "s"))
    return [*docs, (1, None, "en", "s"), (2, "", None, "s"), (None, "New York " * 40, "en", None), docs[3], docs[3], (7, "again " * 100_000, "fr", "s"), (8, "... ,,", "xx", "s")]


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_collocations_equal_brute_force(spark, sent):
    docs = phrase_texts()
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("key", F.lit("clash")).withColumn("n", F.lit(9)).repartition(5)
    got = sorted(map(tuple, collocations.mine_collocations(frame, least=30, top=7, most_sent=sent).collect()))
    assert got == plain_collocations(docs, 30, 7)
    assert len({r[0] for r in got}) >= 5


def test_collocations_of_tables_without_phrases(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine_collocations(spark.createDataFrame([(1, "one two", "en", "s"), (2, None, None, None)], SCHEMA)).collect() == []
