"""Interaction audit of document filters: what each filter removes in every order that the filters can have.

Every document gets a mask of the checks that it fails. Exact duplicates are found by sorting: rows are range-sorted by a
text fingerprint and id, each task sorts its range by fingerprint, whole text and id and compares every row with the one
before it. A group of copies may span many ranges: each task hands on the runs that its range ends in, and rows at the
start of a later range meet them by digest. Documents of the same part and mask behave alike in every order, so all
figures are sums over at most 2 ^ checks counters a part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.llm.spark_files import small_batches, with_checkpoint_dir

#: A check gets the UTF-8 text and its words (maximal runs without ASCII white space) and says whether the text fails.
Check = Callable[[bytes, list[bytes]], bool]
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)


def too_short(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 50


def repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    """Over 5 % of the code points are A-Z."""
    return 100 * len(text.translate(None, _NOT_CAPITAL)) > 5 * len(text.translate(None, _CONTINUED))


def marked_up(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, b"#$%&*|")) < len(text)


CHECKS: dict[str, Check] = {"A": too_short, "B": repetitive, "C": shouting, "D": marked_up}
DUPLICATE = "E"


def failure_masks(docs: DataFrame, checks: Mapping[str, Check] = CHECKS) -> DataFrame:
    """doc_id, part, mask of every row, and open, slot: what is left to decide about duplicates; then the carry rows.

    Bit i of mask: the i-th check fails; the next bit: a smaller doc_id earlier in the same range has the same text. Where
    ``open`` is not null, an earlier range may hold the text of this digest. Carry rows (carry = true) are the runs of the
    last fingerprint of each range with a non-null id: digest in ``open``, range number in ``slot``.
    """
    small_batches(docs.sparkSession)
    tests, same = list(checks.values()), 1 << len(checks)
    sorted_rows = (
        docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("print", F.xxhash64("text"))
        # whole texts stay out of the range keys: samples of these go to the driver
        .repartitionByRange("print", "doc_id")
        .sortWithinPartitions("print", "text", "doc_id")
        .select("doc_id", "part", "print", F.col("text").cast("binary").alias("text"))
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, open binary, slot int, carry boolean"

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        first = at = text = digest = least = None
        mask, runs, id_type = 0, {}, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            masks: list[int] = []
            opened: list[bytes | None] = []
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("print").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for doc, key, body in rows:
                if first is None:
                    first = key
                if key != at:
                    at, text, runs = key, None, {}
                if body != text:
                    text, digest, least = body, hashlib.sha256(body).digest(), None
                    words = body.split()
                    mask = sum(1 << i for i, fails in enumerate(tests) if fails(body, words))
                if least is None and doc is not None:
                    least = runs[digest] = doc
                masks.append(mask | (same if least is not None and doc is not None and doc > least else 0))
                opened.append(digest if key == first else None)
            many = len(masks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(opened, pa.binary()), pa.array([None if x is None else slot for x in opened], pa.int32()), pa.array([False] * many)],
                names=["doc_id", "part", "mask", "open", "slot", "carry"],
            )
        if runs:
            n = len(runs)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32()), pa.array(list(runs), pa.binary()), pa.array([slot] * n, pa.int32()), pa.array([True] * n)],
                names=["doc_id", "part", "mask", "open", "slot", "carry"],
            )

    return sorted_rows.mapInArrow(marked, schema)


def mask_counters(docs: DataFrame, labels: DataFrame, checks: Mapping[str, Check] = CHECKS) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and set of failed filters, and how many of them are labelled so."""
    with_checkpoint_dir(docs.sparkSession)
    folder = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/filter-masks-{uuid.uuid4().hex}"
    # range numbers must not change between the rows and the carry rows: both are read from one written table
    failure_masks(docs, checks).write.parquet(folder)
    table = docs.sparkSession.read.parquet(folder)
    rows = table.where("NOT carry").withColumn("has_id", F.col("doc_id").isNotNull())
    flags = labels.groupBy("doc_id").agg(F.max(F.col("quality").cast("int") == 1).alias("good"), F.max(F.col("toxic").cast("int") == 1).alias("toxic")).where("good OR toxic")
    keys = ["part", "mask", "open", "slot", "has_id"]
    labelled = rows.join(flags, "doc_id").groupBy(*keys).agg(F.lit(0).cast("long").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("good", F.lit(0).cast("long")).withColumn("toxic", F.lit(0).cast("long"))
    # at most one row for each range and text that shares its last fingerprint
    carried = table.where("carry").groupBy("open").agg(F.min("slot").alias("since"))
    known = counted.unionByName(labelled).join(F.broadcast(carried), "open", "left")
    twice = F.col("has_id") & F.coalesce(F.col("since") < F.col("slot"), F.lit(False))
    mask = F.col("mask").bitwiseOR(F.when(twice, 1 << len(checks)).otherwise(0))
    return known.groupBy("part", mask.alias("mask")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def order_effects(spark: SparkSession, names: str) -> DataFrame:
    """For each mask of failed filters, order and step: whether a document with it is kept, removed and so on there, as 0 or 1.

    ``share``: in how many of all orders the step's filter removes it. 2 ^ n * n! * n rows, 19,200 for five filters.
    """
    rows = []
    orders = ["".join(p) for p in permutations(names)]
    for mask in range(1 << len(names)):
        failed = {f for i, f in enumerate(names) if mask >> i & 1}
        share = len(orders) // len(failed) if failed else 0
        for order in orders:
            gone = next((i for i, f in enumerate(order) if f in failed), len(order))
            for i, f in enumerate(order):
                rows.append((mask, order, i + 1, int(i < gone), int(i == gone), int(f in failed and i > gone), int(failed == {f}), share if f in failed else 0))
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, kept int, removed int, redundant int, alone int, share int")


def audit_filters(docs: DataFrame, labels: DataFrame, checks: Mapping[str, Check] = CHECKS, duplicate: str = DUPLICATE) -> DataFrame:
    """One row per part, filter_order and step, for all orders of the checks and the duplicate filter (at most 6 in all).

    Columns: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, all long. A null source is the part
    ``''``, a null text is empty; a row without doc_id is no duplicate and makes none; rows of one id and text are no
    duplicates of each other. Documents without a label, and labels without a document, count in no loss; of several
    labels of an id one of 1 is enough. An empty table gives no rows; further columns are not read.
    """
    counters = mask_counters(docs, labels, checks)
    # a fixed table, whatever the data
    effects = F.broadcast(order_effects(docs.sparkSession, "".join(checks) + duplicate))

    def total(of: str, where: str):
        return F.sum(F.col(of) * F.col(where))

    return counters.join(effects, "mask").groupBy("part", "filter_order", "step").agg(
        total("n", "kept").alias("kept"),
        total("n", "removed").alias("removed"),
        total("n", "redundant").alias("redundant"),
        total("n", "alone").alias("unique_fails"),
        total("good", "removed").alias("good_lost"),
        total("toxic", "removed").alias("toxic_lost"),
        total("n", "share").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and the counts of each, for the five filters over all of documents."""
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
judged AS (
  SELECT x.doc_id, x.part,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END ||
         CASE WHEN 100 * (length(x.t) - length(regexp_replace(x.t, '[A-Z]', '', 'g'))) > 5 * length(x.t) THEN 'C' ELSE '' END ||
         CASE WHEN regexp_matches(x.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN x.doc_id > first_id THEN 'E' ELSE '' END AS failed
  FROM texts x JOIN least l ON x.t = l.t
), flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM judged j LEFT JOIN flags f ON j.doc_id = f.doc_id GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
met AS (
  SELECT part, failed, n, good, toxic, filter_order, step, contains(failed, filter_order[step]) AS fails,
         list_min(list_append(list_transform(string_split(failed, ''), lambda f: CASE WHEN f = '' THEN 6 ELSE strpos(filter_order, f) END), 6)) AS gone
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step,
         CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN failed = filter_order[step] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM summed
"""
