"""Exact top-k search by distributed histogram selection.

All scores are computed block against block, never kept. Each round counts them per query in equal bins of the interval
that is known to hold the k-th highest score; bins add up over all blocks, and the bin that holds the k-th score is the
next interval, until it is one score wide. Of a block only its highest bins are sent, down to the one in which the block
alone has k scores: the k-th of all can't be below. A last round lets through what is above the k-th score, and of the rows
at it the smallest ids of each block; a window ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brandlens.llm.spark_files import with_checkpoint_dir
from brandlens.llm.vectors import AT_ONCE, BLOCK_QUERIES, BLOCK_ROWS, matrix, usable_vectors, with_row_id

BINS = 4096
_LONGS = np.iinfo(np.int64)


def _wrapped(x: np.ndarray) -> np.ndarray:
    """Whole-numbered doubles modulo 2^64, as int64."""
    r = np.fmod(x, 2.0**64)
    r = np.where(r >= 2.0**63, r - 2.0**64, np.where(r < -(2.0**63), r + 2.0**64, r))
    return r.astype(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int64[rows of a, rows of b]: exact inner products of whole-numbered doubles of any size.

    A product that doesn't fit a long is the largest or the least long.
    """
    dims = a.shape[1]
    if np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * dims < 2**53:
        return (a @ b.T).astype(np.int64)
    # modulo 2^64 the sum is exact; doubles tell whether it fits
    with np.errstate(over="ignore", invalid="ignore"):
        out = _wrapped(a) @ _wrapped(b).T
        about = a @ b.T
        slack = (np.abs(a) @ np.abs(b).T) * (dims + 2) * 2.0**-52
        fits, high, low = np.abs(about) + slack < 2.0**63, about - slack >= 2.0**63, about + slack < -(2.0**63)
    out[high], out[low] = _LONGS.max, _LONGS.min
    for i, j in zip(*np.nonzero(~(fits | high | low)), strict=True):
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))
        out[i, j] = max(_LONGS.min, min(_LONGS.max, exact))
    return out


def _met(queries: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Some queries at a time: they, their scores int64[queries, rows], and which pairs are not a row with itself."""
    dims = len(rows["vector"].iloc[0])
    b, own = matrix(rows["vector"], dims), rows["row_id"].to_numpy()
    for first in range(0, len(queries), AT_ONCE):
        part = queries.iloc[first : first + AT_ONCE]
        yield part, inner_products(matrix(part["vector"], dims), b), part["row_id"].to_numpy()[:, None] != own[None, :]


def _empty(*names: str) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})


def _count(width: int):
    """Per query, how many scores fall in the highest bins of its interval [low, low + BINS * width)."""
    names = ("row_id", "bin", "n")

    def counted(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return _empty(*names)
        out = []
        for part, scores, others in _met(queries, rows):
            low = part["low"].to_numpy()[:, None]
            with np.errstate(over="ignore"):
                bins = (scores - low).view(np.uint64) // np.uint64(width)
            inside = others & (scores >= low) & (bins < BINS)
            q, _ = np.nonzero(inside)
            counts = np.bincount(q * BINS + bins[inside].astype(np.int64), minlength=len(part) * BINS).reshape(len(part), BINS)[:, ::-1]
            above = counts.cumsum(axis=1) - counts
            at, place = np.nonzero((counts > 0) & (above < part["need"].to_numpy()[:, None]))
            out.append(pd.DataFrame({"row_id": part["row_id"].to_numpy()[at], "bin": BINS - 1 - place, "n": counts[at, place]}))
        return pd.concat(out, ignore_index=True)

    return counted


def _let_through(k: int):
    names = ("row_id", "query_id", "candidate", "vec_id", "score")

    def filtered(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return _empty(*names)
        rows = rows.sort_values(["vec_id", "row_id"], ignore_index=True)
        out = []
        for part, scores, others in _met(queries, rows):
            at = part["low"].to_numpy()[:, None]
            tied = (scores == at) & others
            q, c = np.nonzero(((scores > at) & others) | (tied & (np.cumsum(tied, axis=1) <= k)))
            found = (part["row_id"].to_numpy()[q], part["query_id"].to_numpy()[q], rows["row_id"].to_numpy()[c], rows["vec_id"].to_numpy()[c], scores[q, c])
            out.append(pd.DataFrame(dict(zip(names, found, strict=True))))
        return pd.concat(out, ignore_index=True)

    return filtered


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller vec_id.

    ``vectors``: row_id, vec_id, vector (whole-numbered doubles); ``queries``: row_id, query_id, vector. A row with the
    query's row_id is no candidate, and vectors of another length than the query's aren't either; other rows of the query's
    id are. Without row_id ids are taken to be unique. Every query row has its own ranks. Fewer candidates give fewer rows; no
    query or no vector gives none. A score that doesn't fit a long is the largest or least long; other columns are ignored.
    """
    with_checkpoint_dir(vectors.sparkSession)
    vectors, queries = with_row_id(vectors, "vec_id"), with_row_id(queries, "query_id")
    # key: a block of queries against a block of rows of one length; both are split by a hash of the row
    size = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    n_queries = queries.count()
    row_blocks, query_blocks = max(1, -(-size["n"] // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    norm = size["norm"] or 0.0
    reach = int(norm * (1 + 1e-9)) + 1 if norm < 2.0**62 else _LONGS.max  # no inner product is larger, and none leaves a long
    key = ["rb", "qb", "dims"]
    block = lambda n: F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("row_id", "vec_id", "vector", block(row_blocks).alias("rb"), every(query_blocks).alias("qb"), F.size("vector").alias("dims"))
    rounds = 1
    while BINS**rounds < 2 * reach + 2:
        rounds += 1
    least = -reach if reach < _LONGS.max else _LONGS.min
    state = queries.select("*", F.lit(least).cast("bigint").alias("low"), F.lit(k).cast("bigint").alias("need"))

    def against_rows(state: DataFrame, function, schema: str) -> DataFrame:
        asked = state.select("*", block(query_blocks).alias("qb"), every(row_blocks).alias("rb"), F.size("vector").alias("dims"))
        return asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(function, schema)

    for step in range(rounds - 1, -1, -1):
        width = BINS**step
        counts = against_rows(state, _count(width), "row_id bigint, bin bigint, n bigint").groupBy("row_id", "bin").agg(F.sum("n").alias("n"))
        # at most BINS entries for each query, highest first; walk down to the bin of the k-th score
        bins = counts.groupBy("row_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("bins"))
        joined = state.join(bins, "row_id", "left")
        walked = F.aggregate(
            F.coalesce("bins", F.expr("cast(array() AS array<struct<bin:bigint,n:bigint>>)")),
            F.struct(F.col("need"), F.lit(-1).cast("bigint").alias("bin")),
            lambda s, b: F.when(s["bin"] >= 0, s).when(b["n"] >= s["need"], F.struct(s["need"].alias("need"), b["bin"].alias("bin"))).otherwise(F.struct((s["need"] - b["n"]).alias("need"), s["bin"].alias("bin"))),
        )
        found = F.col("w.bin") >= 0
        # too few rows in all: everything from the lowest score is let through
        state = joined.withColumn("w", walked).select(
            "row_id", "query_id", "vector",
            F.when(found, (F.col("low").cast("decimal(38,0)") + F.col("w.bin").cast("decimal(19,0)") * F.lit(width).cast("decimal(19,0)")).cast("bigint")).otherwise(F.col("low")).alias("low"),
            F.when(found, F.col("w.need")).otherwise(F.col("need")).alias("need"),
        ).checkpoint()
    found = against_rows(state, _let_through(k), "row_id bigint, query_id bigint, candidate bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "vec_id", "candidate")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """row_id, vec_id and floor(256 * x) of every component, as double; beyond 2^53 a double is whole already."""
    scaled = lambda x: F.greatest(F.least(x * 256, F.lit(1.7e308)), F.lit(-1.7e308))
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return vectors.select("row_id", "vec_id", F.transform("vector", lambda x: whole(scaled(x))).alias("vector"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of every embeddings row whose vec_id is divisible by 50, against all other rows."""
    whole = whole_vectors(usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(whole, whole.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), k=5)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row_no AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row_no <> c.row_no AND len(q.e) = len(c.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
