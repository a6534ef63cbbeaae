"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words with single spaces between them, as UTF-8 bytes, and an end symbol (byte 0xFF, which UTF-8
never has; it also fills the context before the first byte). A byte is eight binary decisions, each with a context tree of
its own: the tree's nodes are the last 0 to ``depth`` bytes. A node has a Krichevsky-Trofimov estimate from the zeros and
ones that the learning texts have there. Its weighted probability is half the estimate's and half the product of its
children's, which gives each node the posterior weight that the tree ends there; a decision's probability is the mixture
over the nodes on its path. A context that no learning text has is no part of the tree: its nearest ancestor is the leaf.

The model is spread over tables, never gathered in one place. Texts are cut into blocks. A block sends its distinct grams
(context and byte) and words out, packed by hash bucket; they are counted there, and what the model says of each comes back
in the same order. Below contexts of ``SPLIT`` bytes the tree falls into subtrees of at most 2 ** (8 * (depth + 1 - SPLIT))
grams, which are weighted side by side; above, each level is one aggregation.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.llm.language_id import fold
from brandlens.llm.spark_files import small_batches, with_checkpoint_dir
from brandlens.llm.text_arrays import mix

#: Bytes of context (6 at most: context and byte are one 64-bit key), of a block, of a piece of a long text; the count that a word has beyond its own.
DEPTH, BLOCK_BYTES, PIECE_BYTES, EXTRA = 5, 32 << 20, 1 << 20, 0.1
#: Context bytes that subtrees share; bytes of text for each hash bucket; grams of a group of subtrees, on average.
SPLIT, BUCKET_BYTES, GROUP_GRAMS = 3, 32 << 20, 1 << 19
#: Bytes whose grams are looked up at once. Logarithms travel as whole multiples of UNIT, so their sums don't depend on the order.
SLICE_BYTES, UNIT = 2 << 20, 2.0**-32
END = b"\xff"
PIECES = "block bigint, row bigint, doc_id {}, held_out boolean, head binary, body binary, size bigint"


def packed(values: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane: high planes are mostly zeros, which any codec squeezes."""
    return np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def gram_buckets(grams_: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(grams_.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def word_bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def pieces(data: bytes, depth: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """(the ``depth`` bytes before it, piece) of a text; pieces end after a space, so no word is cut."""
    at = 0
    while at < len(data):
        space = data.find(b" ", at + size - 1) if len(data) - at > size else -1
        end = space + 1 if space >= 0 else len(data)
        yield (END * depth + data[max(0, at - depth) : at])[-depth:] if depth else b"", data[at:end]
        at = end


def cut_texts(docs: DataFrame, depth: int, block_bytes: int, piece_bytes: int) -> DataFrame:
    """Pieces of all texts in order; neighbours share a block of about ``block_bytes``. ``row`` numbers the rows of docs."""
    schema = PIECES.format(docs.schema["doc_id"].dataType.simpleString())
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = TaskContext.get().partitionId() << 40
        size = 0
        for batch in batches:
            blocks: list[int] = []
            source: list[int] = []
            heads: list[bytes] = []
            bodies: list[bytes] = []
            first = row
            for i, text in enumerate(batch.column("text").to_pylist()):
                for head, body in pieces(b" ".join(text.lower().split()) + END, depth, piece_bytes):
                    if size and size + len(body) > block_bytes:
                        block, size = block + 1, 0
                    size += len(body)
                    blocks.append(block)
                    source.append(i)
                    heads.append(head)
                    bodies.append(body)
                row += 1
            at = np.array(source, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(first + at), batch.column("doc_id").take(pa.array(at)), batch.column("held_out").take(pa.array(at)), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary()), pa.array([len(b) for b in bodies], pa.int64())],
                names=["block", "row", "doc_id", "held_out", "head", "body", "size"],
            )

    return rows.mapInArrow(cut, schema)


def grams(heads: list[bytes], bodies: list[bytes], depth: int) -> np.ndarray:
    """A key for every byte of the bodies: the ``depth`` bytes before it, then itself, as one number."""
    data = b"\0" * 7 + b"".join(x for pair in zip(heads, bodies, strict=True) for x in pair)
    # at each byte the big-endian number that it ends
    ending = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,)).astype(np.int64)
    ending &= (1 << (8 * depth + 8)) - 1
    lengths = np.full((len(bodies), 2), depth)
    lengths[:, 1] = [len(b) for b in bodies]
    return ending[np.repeat(np.tile([False, True], len(bodies)), lengths.ravel())]


def numbered_words(bodies: list[bytes], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words of a block, bucket after bucket; where each bucket begins, and the end; the number of each word of the bodies; how many each has.

    The end of a text counts as the empty word.
    """
    # a piece ends with the space after its last word, or with the end of the text
    texts = pa.array([b[:-1] + b" " if len(b) > 1 and b.endswith(END) else b[:-1] for b in bodies], pa.large_binary())
    split = pc.split_pattern(texts, b" ")
    coded = split.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order)).to_pylist()
    of = np.fromiter((word_bucket(w, buckets) for w in words), np.int64, len(words))
    by_bucket = np.argsort(of, kind="stable")
    number = np.empty(len(words), np.int64)
    number[order[by_bucket]] = np.arange(len(words))
    return [words[i] for i in by_bucket.tolist()], np.searchsorted(of[by_bucket], np.arange(buckets + 1)), number[coded.indices.to_numpy()], pc.list_value_length(split).to_numpy()


def _slices(heads: list[bytes], bodies: list[bytes], depth: int) -> Iterator[tuple[int, int, np.ndarray]]:
    first = size = 0
    for i in range(len(bodies) + 1):
        if i == len(bodies) or (i > first and size + len(bodies[i]) > SLICE_BYTES):
            if i > first:
                yield first, i, grams(heads[first:i], bodies[first:i], depth)
            first, size = i, 0
        if i < len(bodies):
            size += len(bodies[i])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bool], list[bytes], list[bytes]]]:
    """The pieces of neighbouring rows with the same block."""
    held: tuple[list[bool], list[bytes], list[bytes]] = ([], [], [])
    at = None
    for batch in batches:
        for block, out, head, body in zip(*[batch.column(c).to_pylist() for c in ("block", "held_out", "head", "body")], strict=True):
            if block != at and held[0]:
                yield at, *held
                held = ([], [], [])
            at = block
            for part, value in zip(held, (out, head, body), strict=True):
                part.append(value)
    if held[0]:
        yield at, *held


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of sorted lists, and the sums of their counts."""
    keys, counts = map(np.concatenate, zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def block_grams(heads: list[bytes], bodies: list[bytes], learnt: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of a block, and how often its learning texts have each."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    waiting = 0
    for first, last, found in _slices(heads, bodies, depth):
        # the lowest bit tells learning texts
        found = np.sort(found << 1 | np.repeat(np.array(learnt[first:last], np.int64), [len(b) for b in bodies[first:last]]))
        start = np.flatnonzero(np.diff(found >> 1, prepend=-1))
        parts.append((found[start] >> 1, np.add.reduceat(found & 1, start)))
        waiting += len(start)
        if waiting > max(SLICE_BYTES, len(parts[0][0])):
            parts, waiting = [_added_up(parts)], 0
    return _added_up(parts)


def sent_items(cut: DataFrame, depth: int, buckets: int) -> DataFrame:
    """block, kind (gram or word), bucket, keys, counts: the distinct items of each block and bucket, packed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, out, heads, bodies in _blocks(batches):
            learnt = [not x for x in out]
            keys, counts = block_grams(heads, bodies, learnt, depth)
            of = gram_buckets(keys, buckets)
            rows = [(block, "gram", k, packed(np.diff(keys[of == k], prepend=0)), packed(counts[of == k])) for k in np.unique(of).tolist()]
            words, begin, number, many = numbered_words(bodies, buckets)
            total = np.bincount(number[np.repeat(np.array(learnt), many)], minlength=len(words))
            rows += [(block, "word", k, b" ".join(words[a:b]), packed(total[a:b])) for k, (a, b) in enumerate(pairwise(begin.tolist())) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["block", "kind", "bucket", "keys", "counts"])

    return cut.select("block", "held_out", "head", "body").mapInArrow(counted, "block bigint, kind string, bucket bigint, keys binary, counts binary")


def gram_totals(items: DataFrame) -> DataFrame:
    """gram, n: in all learning texts."""

    def merged(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(unpacked(x)) for x in group.column("keys").to_pylist()])
        counts = np.concatenate([unpacked(x) for x in group.column("counts").to_pylist()])
        of, own = pd.factorize(keys)
        return pa.table({"gram": own, "n": np.bincount(of, weights=counts, minlength=len(own)).astype(np.int64)})

    return items.where("kind = 'gram'").groupBy("bucket").applyInArrow(merged, "gram bigint, n bigint")


def word_answers(items: DataFrame) -> DataFrame:
    """block, kind, bucket, data: the counts of a block's words in all learning texts; total, distinct of a bucket stand in one of its rows."""

    def merged(group: pa.Table) -> pa.Table:
        totals: Counter[bytes] = Counter()
        rows = [(x.split(b" "), unpacked(c)) for x, c in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True)]
        for words, counts in rows:
            for word, n in zip(words, counts.tolist(), strict=True):
                totals[word] += n
        rest = [0] * (len(rows) - 1)
        return pa.table(
            {
                "block": group.column("block"),
                "kind": group.column("kind"),
                "bucket": group.column("bucket"),
                "data": pa.array([packed(np.fromiter(map(totals.__getitem__, words), np.int64, len(words))) for words, _ in rows], pa.binary()),
                "total": pa.array([sum(totals.values()), *rest], pa.int64()),
                "distinct": pa.array([sum(n > 0 for n in totals.values()), *rest], pa.int64()),
            }
        )

    return items.where("kind = 'word'").groupBy("bucket").applyInArrow(merged, "block bigint, kind string, bucket bigint, data binary, total bigint, distinct bigint")


def log_gamma(x: Column | np.ndarray) -> Column | np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series at x + 8."""
    ln = F.ln if isinstance(x, Column) else np.log
    y = x + 8
    part = 1.0 / y
    series = part * (1 / 12 - part * part * (1 / 360 - part * part * (1 / 1260 - part * part / 1680)))
    rising = x
    for i in range(1, 8):
        rising = rising * (x + i)
    return (y - 0.5) * ln(y) - y + 0.5 * math.log(2 * math.pi) + series - ln(rising)


def log_estimate(n0: Column | np.ndarray, n1: Column | np.ndarray) -> Column | np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


@dataclass
class Nodes:
    """Nodes of one context length: keys (context, and the bits before after a leading 1), counts, stop: the weight that the tree ends there."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    stop: np.ndarray


@dataclass
class Subtrees:
    """Levels from the longest contexts to those of ``top`` bytes, each node's parent, and each decision's node and bit."""

    levels: list[Nodes]
    parents: list[np.ndarray]
    weighted: np.ndarray
    at: np.ndarray
    bit: np.ndarray


def subtrees(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> Subtrees:
    byte, context, j = gram & 255, gram & ~255, np.arange(8)[:, None]
    bit = ((byte >> (7 - j)) & 1).ravel()
    key, at = np.unique((context | (1 << j) | (byte >> (8 - j))).ravel(), return_inverse=True)
    n1, n = np.bincount(at, weights=np.tile(n, 8) * bit, minlength=len(key)), np.bincount(at, weights=np.tile(n, 8), minlength=len(key))
    levels, parents = [Nodes(key, n - n1, n1, np.ones(len(key)))], []
    weighted = log_estimate(n - n1, n1)
    for d in range(depth - 1, top - 1, -1):
        key, up = np.unique(levels[-1].key & ((1 << (8 * d + 8)) - 1), return_inverse=True)
        n0, n1, below = (np.bincount(up, weights=x, minlength=len(key)) for x in (levels[-1].n0, levels[-1].n1, weighted))
        own = log_estimate(n0, n1)
        weighted = np.logaddexp(own, below) - math.log(2)
        levels.append(Nodes(key, n0, n1, np.exp(own - math.log(2) - weighted)))
        parents.append(up)
    return Subtrees(levels, parents, weighted, at, bit)


def gram_values(tree: Subtrees, mixed: np.ndarray, rest: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's byte. The state above the top nodes: the mixture so far, the weight left, the probability of a 1."""
    for i in range(len(tree.levels) - 1, -1, -1):
        nodes = tree.levels[i]
        seen = nodes.n0 + nodes.n1 > 0
        own = (nodes.n1 + 0.5) / (nodes.n0 + nodes.n1 + 1)
        one = np.where(seen, mixed + rest * own, one)
        mixed, rest = mixed + rest * nodes.stop * own, rest * (1 - nodes.stop)
        if i:
            mixed, rest, one = (x[tree.parents[i - 1]] for x in (mixed, rest, one))
    chance = one[tree.at]
    return np.log10(np.where(tree.bit == 1, chance, 1 - chance)).reshape(8, -1).sum(axis=0)


def upper_states(nodes: DataFrame, top: int, folder: str) -> DataFrame:
    """key, mixed, rest, one: the state above each node of contexts of ``top`` bytes. nodes: key, n0, n1, weighted.

    Weighted probabilities add up level by level to the empty context, and mixtures come down again; a node has at most
    256 children, so no key of these joins is hot.
    """
    levels = []
    below = nodes
    for d in range(top - 1, -1, -1):
        level = below.groupBy(F.expr(f"key & {(1 << (8 * d + 8)) - 1}L").alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        level = level.withColumn("own", log_estimate(F.col("n0"), F.col("n1")))
        level = level.withColumn("weighted", F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - math.log(2))
        level.withColumn("stop", 1 / (1 + F.exp(F.col("below") - F.col("own")))).drop("own", "below").write.parquet(f"{folder}/level-{d}")
        below = nodes.sparkSession.read.parquet(f"{folder}/level-{d}")
        levels.append(below)
    state = None
    own = F.expr("(n1 + 0.5D) / (n0 + n1 + 1D)")
    for d, level in enumerate([*levels[::-1], nodes]):
        if state is None:
            joined = level.withColumns({"mixed": F.lit(0.0), "rest": F.lit(1.0), "one": F.lit(0.5)})
        else:
            joined = level.withColumn("parent", F.expr(f"key & {(1 << (8 * d)) - 1}L")).join(state.withColumnRenamed("key", "parent"), "parent")
        if d == top:
            return joined.select("key", "mixed", "rest", "one")
        state = joined.select(
            "key",
            (F.col("mixed") + F.col("rest") * F.col("stop") * own).alias("mixed"),
            (F.col("rest") * (1 - F.col("stop"))).alias("rest"),
            F.when(F.expr("n0 + n1 > 0"), F.col("mixed") + F.col("rest") * own).otherwise(F.col("one")).alias("one"),
        )


def gram_logs(totals: DataFrame, depth: int, buckets: int, folder: str) -> DataFrame:
    """bucket, gram, value: log10 of the probability of a gram's last byte after its context, in units of UNIT."""
    spark, top = totals.sparkSession, min(SPLIT, depth)
    groups = max(1, totals.count() // GROUP_GRAMS)
    group = F.pmod(F.xxhash64(F.expr(f"shiftright(gram, 8) & {(1 << (8 * top)) - 1}L")), F.lit(groups)).alias("group")
    node_group = F.pmod(F.xxhash64(F.expr(f"shiftright(key, 8) & {(1 << (8 * top)) - 1}L")), F.lit(groups)).alias("group")

    def sorted_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        gram = table.column("gram").to_numpy()
        order = np.argsort(gram)
        return gram[order], table.column("n").to_numpy()[order]

    def weighted(table: pa.Table) -> pa.Table:
        tree = subtrees(*sorted_grams(table), depth, top)
        last = tree.levels[-1]
        return pa.table({"key": last.key, "n0": last.n0.astype(np.int64), "n1": last.n1.astype(np.int64), "weighted": tree.weighted})

    grouped = totals.select(group, "gram", "n").groupBy("group")
    grouped.applyInArrow(weighted, "key bigint, n0 bigint, n1 bigint, weighted double").write.parquet(f"{folder}/nodes")
    states = upper_states(spark.read.parquet(f"{folder}/nodes"), top, folder).select(node_group, "key", "mixed", "rest", "one")

    def valued(table: pa.Table, above: pa.Table) -> pa.Table:
        gram, n = sorted_grams(table)
        # both sides have the same keys, and the tree's are sorted
        order = np.argsort(above.column("key").to_numpy())
        value = gram_values(subtrees(gram, n, depth, top), *[above.column(c).to_numpy()[order] for c in ("mixed", "rest", "one")])
        return pa.table({"bucket": gram_buckets(gram, buckets), "gram": gram, "value": np.round(value / UNIT).astype(np.int64)})

    return grouped.cogroup(states.groupBy("group")).applyInArrow(valued, "bucket bigint, gram bigint, value bigint")


def gram_answers(items: DataFrame, logs: DataFrame) -> DataFrame:
    """block, kind, bucket, data: the values of a block's grams in their order."""

    def answered(group: pa.Table, model: pa.Table) -> pa.Table:
        gram, value = model.column("gram").to_numpy(), model.column("value").to_numpy()
        order = np.argsort(gram)
        gram, value = gram[order], value[order]
        data = [packed(value[np.searchsorted(gram, np.cumsum(unpacked(x)))]) for x in group.column("keys").to_pylist()]
        return pa.table({"block": group.column("block"), "kind": group.column("kind"), "bucket": group.column("bucket"), "data": pa.array(data, pa.binary())})

    return items.where("kind = 'gram'").drop("counts").groupBy("bucket").cogroup(logs.groupBy("bucket")).applyInArrow(answered, "block bigint, kind string, bucket bigint, data binary")


def score_texts(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row of docs.

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0. score is the log10 probability of the lower-cased
    words with single spaces between them, and the end; n_bytes counts their bytes and the end. Null and empty texts are
    the end alone. A row without doc_id is a learning row. Repeated rows are scored, and learnt from, each; further columns
    are not read; an empty table gives an empty result. With no learning row every decision has probability 1/2.
    """
    spark = docs.sparkSession
    with_checkpoint_dir(spark)
    small_batches(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/context-tree-{uuid.uuid4().hex}"
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def written(table: DataFrame, name: str) -> DataFrame:
        table.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # numbers of blocks and rows must not change, so everything reads this one table
    cut = written(cut_texts(docs, depth, block_bytes, piece_bytes), "pieces")
    buckets = max(1, (cut.agg(F.sum("size")).first()[0] or 0) // bucket_bytes)
    items = written(sent_items(cut, depth, buckets), "items")
    words = written(word_answers(items), "words")
    seen = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    tokens, whole = int(seen["n"]), int(seen["n"]) + EXTRA * (int(seen["v"]) + 1)
    logs = gram_logs(written(gram_totals(items), "totals"), depth, buckets, folder)
    answers = gram_answers(items, logs).unionByName(words.select("block", "kind", "bucket", "data"))

    def scored(texts: pa.Table, model: pa.Table) -> pa.Table:
        heads, bodies = texts.column("head").to_pylist(), texts.column("body").to_pylist()
        said: dict[str, dict[int, bytes]] = {"gram": {}, "word": {}}
        for kind, bucket, data in zip(*[model.column(c).to_pylist() for c in ("kind", "bucket", "data")], strict=True):
            said[kind][bucket] = data
        lengths = np.array([len(b) for b in bodies], np.int64)
        keys, _ = block_grams(heads, bodies, [False] * len(bodies), depth)
        log = np.empty(len(keys), np.int64)
        log[np.argsort(gram_buckets(keys, buckets), kind="stable")] = np.concatenate([unpacked(said["gram"][k]) for k in sorted(said["gram"])])
        score = np.zeros(len(bodies), np.int64)
        place = pd.Index(keys)
        for first, last, found in _slices(heads, bodies, depth):
            starts = np.cumsum(lengths[first:last]) - lengths[first:last]
            score[first:last] = np.add.reduceat(log[place.get_indexer(found)], starts)
        _, _, number, many = numbered_words(bodies, buckets)
        count = np.concatenate([unpacked(said["word"][k]) for k in sorted(said["word"])])
        base = np.log10((count + EXTRA) / whole)
        of_word = np.split(number, np.cumsum(many)[:-1])
        return pa.table(
            {
                "row": texts.column("row"),
                "doc_id": texts.column("doc_id"),
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array([len(i) for i in of_word], pa.int64()),
                "n_known": pa.array([int((count[i] > 0).sum()) for i in of_word], pa.int64()),
                "base": pa.array([float(base[i].sum()) for i in of_word], pa.float64()),
                "score": pa.array(score),
                "n_bytes": pa.array(lengths),
            }
        )

    parts = cut.drop("size").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, f"row bigint, doc_id {doc_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, score bigint, n_bytes bigint"
    )
    score = F.sum("score") * UNIT
    return parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        score.alias("score"),
        F.sum("n_bytes").alias("n_bytes"),
        (-score / math.log10(2) / F.sum("n_bytes")).alias("bits_per_byte"),
    ).drop("row")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, unigram base score and context-tree score of every row of documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
