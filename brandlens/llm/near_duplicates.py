"""N-gram Jaccard self-join of texts by MinHash banding, and near-duplicate classes.

1. Every text becomes its set of hashed five-word shingles; equal sets are one node (copies are never paired).
2. Band hashes of a node's MinHash signature are shuffled; nodes that share one are in a bucket. Buckets of the same
   nodes are one bucket.
3. Every pair within a bucket is verified on the full sets, once: in the least bucket that holds both. A bucket is cut
   into blocks of bounded rows and bytes and block meets block in one task, so neither pairs nor a whole bucket are ever
   brought together; a task returns sums and at most one link a node for each pair of blocks.
4. Connected components of the verified links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.llm.spark_files import small_batches, with_checkpoint_dir
from brandlens.llm.text_arrays import mix, shingle_sets

WIDTH, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 160
#: Nodes and shingles of a block, on average; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


def bands_for(threshold: float, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which bands that reach ``recall`` at ``threshold`` need no more hashes."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if best is None or bands * rows <= most_hashes:
            best = (bands, rows)
        else:
            break
    return best


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each multiplicative hash over the shingles."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 1024):
            np.minimum(out, (factors[:, None] * shingles[None, a : a + 1024]).min(axis=1), out=out)
    return out


def _signed(width: int, bands: int, rows: int):
    factors = multipliers(bands * rows)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes: list[int | None] = []
            sizes: list[int] = []
            hashes: list[np.ndarray] = []
            with np.errstate(over="ignore"):
                for shingles in shingle_sets(batch.column("text").to_pylist(), width):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        nodes.append(None)
                        hashes.append(np.empty(0, np.int64))
                        continue
                    whole = mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))]))
                    nodes.append(int(whole.view(np.int64)[0]))
                    band = np.arange(bands, dtype=np.uint64)
                    for row in signature(shingles, factors).reshape(bands, rows).T:
                        band = mix(band * np.uint64(0x9FB21C651E98DF25) + row)
                    hashes.append(band.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(h) for h in hashes])), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *hashes])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists], names=[*batch.schema.names[:-1], "node", "size", "bands"])

    return signed


def _text_key() -> list[Column]:
    """_t1 and _t2, a 128-bit key of text."""
    return [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit("text"), "text").alias("_t2")]


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with _k1 and _k2, a 128-bit key of doc_id and text: equal for repeated rows only."""
    return docs.withColumn("_k1", F.xxhash64("doc_id", "text")).withColumn("_k2", F.xxhash64(F.lit("near"), "text", "doc_id"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a, b) is either a centre b or hangs on one centre."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("centre")))
    return roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("centre").alias("centre")).where("hangs + centre > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``edges`` (a, b: bigint).

    Alternates the large-star and the small-star step until only stars are left; every step aggregates before it shuffles
    and adds at most as many links as it has. Each round is a checkpoint; so are the least neighbours, which leaves plain
    joins whose crowded partitions (a node with very many neighbours) Spark splits.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).checkpoint()
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").checkpoint()
        below = large.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        joined = large.join(below, "a")
        small = joined.select("a", F.col("m").alias("b")).unionAll(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = small.distinct().checkpoint()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every set of ``left`` with every set of ``right``, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    a_row, b_row = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    a, b = (np.concatenate(s) if s else np.empty(0, np.uint64) for s in (left, right))
    common = np.intersect1d(a, b)
    a_at, b_at = np.searchsorted(common, a), np.searchsorted(common, b)
    if not len(common):
        return out
    a_in, b_in = (common[np.minimum(at, len(common) - 1)] == x for at, x in ((a_at, a), (b_at, b)))
    a_row, a_at, b_row, b_at = a_row[a_in], a_at[a_in], b_row[b_in], b_at[b_in]
    a_order, b_order = np.argsort(a_at, kind="stable"), np.argsort(b_at, kind="stable")
    a_row, a_at, b_row, b_at = a_row[a_order], a_at[a_order], b_row[b_order], b_at[b_order]
    step = 4096
    for first in range(0, len(common), step):
        cut = [np.searchsorted(at, (first, first + step)) for at in (a_at, b_at)]
        dense = []
        for rows, at, (lo, hi), n in ((a_row, a_at, cut[0], len(left)), (b_row, b_at, cut[1], len(right))):
            m = np.zeros((n, min(step, len(common) - first)), np.float32)
            m[rows[lo:hi], at[lo:hi] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The int64 lists of a column."""
    offsets = column.offsets.to_numpy()
    return np.split(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets[1:-1] - offsets[0]) if len(column) else []


def _links(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, root, links of the linked nodes among two blocks of one bucket (or within one block).

    A pair that an earlier bucket holds too is left to it. root is the least node over the links found here.
    """
    of = lambda name: rows.column(name).combine_chunks()
    band, x, y = (of(c)[0].as_py() for c in ("band", "x", "y"))
    block, node, copies = (of(c).to_numpy() for c in ("block", "node", "copies"))
    sets = [np.frombuffer(v, np.uint64) for v in of("shingles").to_pylist()]
    earlier = [k[k < band].view(np.uint64) for k in _lists(of("kept"))]
    at = [np.flatnonzero(block == k) for k in ((x,) if x == y else (x, y))]
    left, right = at[0], at[-1]
    pick = lambda values, i: [values[k] for k in i]
    sizes = [np.array([len(sets[k]) for k in i], float) for i in (left, right)]
    common = overlaps(pick(sets, left), pick(sets, right)).astype(float)
    linked = common / np.maximum(sizes[0][:, None] + sizes[1][None, :] - common, 1) >= threshold
    if linked.any():
        linked &= overlaps(pick(earlier, left), pick(earlier, right)) == 0
    if x == y:
        np.fill_diagonal(linked, False)
    # the least node over links, until nothing changes
    roots, top = node.copy(), np.iinfo(np.int64).max
    while linked.any():
        before = roots.copy()
        for mask, own, other in ((linked, left, right), (linked.T, right, left)):
            roots[own] = np.minimum(roots[own], np.where(mask, roots[other][None, :], top).min(axis=1))
        if (before == roots).all():
            break
    links = np.zeros(len(node), np.int64)
    links[left] = linked @ copies[right]
    if x != y:
        links[right] = linked.T @ copies[left]
    found = links > 0
    return node[found], roots[found], links[found]


def _verify(threshold: float):
    """Rows come sorted by band, x, y; each such run is two blocks, or one block against itself."""
    names = ("node", "root", "links")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def runs(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            found = [_links(table.slice(a, b - a), threshold) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            if any(len(f[0]) for f in found):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = np.column_stack([table.column(c).to_numpy() for c in ("band", "x", "y")])
            ends = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            yield from runs(table, [0, *ends])
            # the last run may go on in the next batch
            held = table.slice(ends[-1] if ends else 0)
        if held is not None:
            yield from runs(held, [0, held.num_rows])

    return verify


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, class_size and the row key _k1, _k2, one row for each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least ``threshold``.
    n_links counts the other rows a row is linked to; class_id is the least doc_id of its connected component (null if
    all are null). Words are runs of letters, digits and ``_``, lower-cased; a text of fewer words is one shingle; a null text
    or one without words is linked to nothing and a class of its own. A pair of exactly the threshold is found with
    probability ``recall``, more similar ones more surely; every pair found is verified on the full sets. An empty table
    gives no rows; other columns are ignored. A node is a 64-bit hash of a set. A task holds the sets of two blocks.
    """
    with_checkpoint_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    keyed = with_row_key(docs.select("doc_id", "text")).select("doc_id", "_k1", "_k2", *_text_key(), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = keyed.mapInArrow(_signed(width, bands, rows), f"doc_id {kind}, _k1 bigint, _k2 bigint, _t1 bigint, _t2 bigint, node bigint, size bigint, bands array<bigint>").checkpoint()
    nodes = (
        signed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("_t1", "_t2")).alias("key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    ).checkpoint()
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("bucket"), "node")).alias("h2")
    )
    # buckets of the same nodes are one: n and 128 bits over the nodes tell them apart
    kept = buckets.where("n > 1").groupBy("n", "h1", "h2").agg(F.min("band").alias("band"), F.first("shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    # a small side is a checkpoint: the join with it stays plain, and Spark splits the partitions of very common keys
    kept = kept.select("band", blocks.alias("blocks")).checkpoint()
    # at most one place for each band
    places = banded.join(kept, "band").groupBy("node").agg(F.collect_list(F.struct("band", "blocks")).alias("places"))
    members = nodes.select("node", "copies", F.col("key._t1").alias("_t1"), F.col("key._t2").alias("_t2")).join(places, "node")
    # equal texts meet before they are shuffled
    texts = docs.select(*_text_key(), "text").where("text IS NOT NULL").groupBy("_t1", "_t2").agg(F.first("text").alias("text"))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    sets = texts.join(members, ["_t1", "_t2"]).select("node", "copies", "places", "text").mapInArrow(as_sets, "node bigint, copies bigint, places array<struct<band: bigint, blocks: int>>, shingles binary")
    met = (
        sets.select("node", "copies", "shingles", F.transform("places", lambda p: p["band"]).alias("kept"), F.explode("places").alias("place"))
        .select("*", F.pmod(F.xxhash64("node"), F.col("place.blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("place.blocks") - 1)).alias("other"))
        .select(F.col("place.band").alias("band"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "kept", "shingles")
    )
    sorted_runs = met.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    verified = sorted_runs.mapInArrow(_verify(threshold), "node bigint, root bigint, links bigint").checkpoint()
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("node", "copies", "least_id").join(links, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    of_class = placed.groupBy("class").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size")).checkpoint()
    facts = placed.join(of_class, "class").select("node", "class_id", "class_size", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = F.col("node").isNull()
    return signed.select("doc_id", "_k1", "_k2", "node").join(facts, "node", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.col("class").alias("_class"),
        "_k1",
        "_k2",
    )


def keep_one_of_each_class(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least doc_id (nulls last) stays.

    Repeated rows (same doc_id and text) leave one, the least in the other columns (those that can be ordered). Rows without
    words stay, one for each doc_id and text. Columns are those of ``docs``; an empty table gives an empty one.
    """
    classes = near_duplicate_classes(docs, **parameters)
    crowded = classes.where("class_size > 1").select("_class", "doc_id", "_k1", "_k2").checkpoint()
    first = crowded.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")).alias("kept")).checkpoint()
    gone = crowded.join(first, "_class").where("_k1 <> kept._k1 OR _k2 <> kept._k2").select("_k1", "_k2").distinct()
    rest = with_row_key(docs).join(gone, ["_k1", "_k2"], "left_anti")
    columns = {f"c{i}": c for i, c in enumerate(docs.columns)}
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name.lower() != "text" and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    one = rest.groupBy("_k1", "_k2").agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()]), F.struct(*ordered)).alias("r"))
    return one.select(*[F.col(f"r.{k}").alias(c) for k, c in columns.items()])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "class_size")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
  WHERE CAST(i AS DOUBLE) / (len(sa.sh) + len(sb.sh) - i) >= 0.8),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.doc_id),
classes AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
counted AS (SELECT a AS doc_id, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links, count(*) OVER (PARTITION BY c.class_id) AS class_size
FROM classes c LEFT JOIN counted n USING (doc_id)
"""
