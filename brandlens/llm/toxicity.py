"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of words, word pairs and pairs around one skipped word, and of words cut to a stem, as
inflected words would else be learnt one by one. A feature counts only if enough learning texts hold it. Learning has a
rate for each coordinate and an L1 penalty, which leaves few weights; these go to the tasks as index and value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brandlens.llm.language_id import fold
from brandlens.llm.spark_files import small_batches, with_checkpoint_dir
from brandlens.llm.text_arrays import by_text, grams, slices, words

BITS = 20
#: Words, neighbours, neighbours but one.
PATTERNS = ((0,), (0, 1), (0, 2))
#: Letters of the stems.
STEMS = (4, 5, 6)


def features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: their number, hashed features (with repeats) and the text of each, in no order."""
    for _, part in slices(texts):
        hashes, owner, *stems = words(part, STEMS)
        found = [grams(hashes, owner, p) for p in PATTERNS] + [(h, owner) for h in stems]
        yield len(part), np.concatenate([h >> np.uint64(64 - BITS) for h, _ in found]).astype(np.int64), np.concatenate([o for _, o in found])


@dataclass
class ToxicityModel:
    """The weights that are not 0, by feature, and the bias."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.value
        return out


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, prior: float, min_texts: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 8) -> ToxicityModel:
    """FTRL-proximal over the rows (distinct feature indexes) in the given order; ``prior``: share of label 1 in the data.

    Features of fewer than ``min_texts`` rows are left out. The bias has no penalty; at the end it moves by the log-odds between the sample's share of label 1 and ``prior``.
    """
    seen = np.zeros(1 << BITS, np.int32)
    for i in rows:
        seen[i] += 1
    often = seen >= min_texts
    rows = [i[often[i]] for i in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            bias = -zb / ((beta + nb**0.5) / alpha + 1e-6)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    every = weights(np.arange(1 << BITS))
    index = np.flatnonzero(every)
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    return ToxicityModel(index, every[index], float(bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share))))


def train_toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_features: int = 4_000_000, min_texts: int = 3) -> ToxicityModel:
    """Fit on a bounded sample: about ``per_class`` labelled documents of each class, drawn by a hash of doc_id.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 0 and whose label is 0 or 1. A document with several
    labels takes the highest, one with several texts the least. Texts are hashed and features of fewer than ``min_texts``
    texts of the sample are dropped in tasks; then texts are taken in the order of the hash until a class has
    ``most_features`` features (16 MB; one text at least). One task fits on these, and only the weights come to the driver.
    Without any labelled row the model has no weight and scores everything below one half.
    """
    with_checkpoint_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    spread = 1 << 30
    rate = {c: int(min(1.0, per_class / max(1, counts.get(c, 0))) * spread) for c in (0, 1)}
    key = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    picked = known.where(key < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sample of ids is bounded by per_class, so it may be broadcast; min() holds one text of an id
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for rows, found, owner in features(batch.column("text").to_pylist()):
                order = np.argsort(owner, kind="stable")
                out += [np.unique(x).astype(np.int32).tobytes() for x in by_text(found[order], owner[order], rows)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("key"), pa.array(out, pa.binary())], names=["toxic", "key", "features"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts of this task have a feature, as one dense table a task."""
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                seen[np.frombuffer(row, np.int32)] += 1
        at = np.flatnonzero(seen)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part])], names=["feature", "n"])

    sized = sample.select("toxic", F.xxhash64("doc_id").alias("key"), "text").mapInArrow(hashed, "toxic int, key bigint, features binary").checkpoint()
    often = sized.select("features").mapInArrow(counted, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= min_texts)
    # at most one row for each hash: 4 MB
    common = np.zeros(1 << BITS, bool)
    common[often.select("feature").toArrow().column(0).to_numpy()] = True

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int32) for x in batch.column("features").to_pylist()]
            kept = [x[common[x]] for x in rows]
            columns = [batch.column("toxic"), batch.column("key"), pa.array([len(x) for x in kept], pa.int64()), pa.array([x.tobytes() for x in kept], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "key", "size", "features"])

    # a window over the rows of the sample, bounded by per_class
    upto = Window.partitionBy("toxic").orderBy("key", "features")
    small = sized.mapInArrow(pruned, "toxic int, key bigint, size bigint, features binary").withColumn("upto", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(upto))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        columns: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            rows += [np.frombuffer(x, np.int32) for x in batch.column("features").to_pylist()]
            columns.append((batch.column("key").to_numpy(), batch.column("toxic").to_numpy()))
        if rows:
            key, toxic = map(np.concatenate, zip(*columns, strict=True))
            order = np.argsort(key, kind="stable")
            model = fit_ftrl([rows[i] for i in order], toxic[order].astype(float), prior, min_texts)
            yield pa.RecordBatch.from_arrays([pa.array([model.index.astype(np.int32).tobytes()]), pa.array([model.value.tobytes()]), pa.array([model.bias])], names=["index", "value", "bias"])

    bounded = small.where((F.col("upto") <= most_features) | (F.col("nth") == 1)).select("toxic", "key", "features")
    found = bounded.repartition(1).mapInArrow(fitted, "index binary, value binary, bias double").first()
    if found is None:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -4.0)
    return ToxicityModel(np.frombuffer(found["index"], np.int32).astype(np.int64), np.frombuffer(found["value"], np.float64), found["bias"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` with toxic_score, the probability of label 1 (replacing a column of this name); a narrow map.

    A null or empty text is scored by the bias alone. Only text is read; every text is read whole.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "toxic_score"]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.select("*", F.lit(0.0).alias("toxic_score")).schema
    at = source.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            sums: list[np.ndarray] = []
            for rows, found, owner in features(batch.column(at).to_pylist()):
                live = table[found] != 0
                pairs = np.unique(owner[live].astype(np.int64) << BITS | found[live])
                sums.append(np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], minlength=rows))
            logit = np.concatenate(sums) + model.bias if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))), pa.float64())], names=[*kept, "toxic_score"])

    return source.mapInArrow(score, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents, learnt from labels; null and empty texts are scored too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )
