"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts with few edges between them; a small network learns to
tell a vector's part. Every row is filed under its most probable part, and a query visits its several most probable
parts, whose rows are ranked by the exact cosine. How much probability the visited parts must hold is set on held-out
rows of the sample for a target recall: clustered vectors need few parts, unstructured ones many.

There are about sqrt(n) / 2 parts, 256 at most. Where this leaves more than LEAF rows in a part, each part is cut again
in the same way, by a network that a task learns from a sample of the part; its leaves are then what rows are filed under.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brandlens.llm.vectors import AT_ONCE, BLOCK_QUERIES, BLOCK_ROWS, matrix, usable_vectors, with_row_id

#: Parts at most, and rows of a part above which it is cut again.
MOST_PARTS, LEAF = 256, 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """int[rows, k]: the k nearest other rows by cosine (unit rows), in blocks."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row, none over ``slack`` times the mean, with few graph edges cut.

    Starts from medians along principal axes, then moves rows to the part that holds most of their neighbours, those
    with the highest gain first and only as long as the part has room.
    """
    part = np.zeros(len(x), np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            part[own[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]]] += made
        made *= 2
    room = int(slack * len(x) / parts) + 1
    both = np.concatenate([np.column_stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.column_stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])])
    for _ in range(rounds):
        links = np.bincount(both[:, 0] * parts + part[both[:, 1]], minlength=len(x) * parts).reshape(len(x), parts)
        best = links.argmax(axis=1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer and a softmax over parts; a query visits the most probable parts until they hold ``mass``.

    ``inner``: a router for each part that is cut again, by number. Leaves of all parts are numbered part by part.
    """

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0
    inner: dict[int, Router] = field(default_factory=dict)

    def own(self, x: np.ndarray) -> np.ndarray:
        """Probability of each part, without regard to inner routers."""
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probability of each leaf."""
        p = self.own(x)
        if not self.inner:
            return p
        return np.concatenate([p[:, [k]] * self.inner[k].own(x) if k in self.inner else p[:, [k]] for k in range(p.shape[1])], axis=1)

    def filed(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the most probable part, and in it the most probable leaf."""
        part = self.own(x).argmax(axis=1)
        sizes = np.array([len(self.inner[k].b2) if k in self.inner else 1 for k in range(len(self.b2))])
        leaf = (np.cumsum(sizes) - sizes)[part]
        for k in np.unique(part):
            if k in self.inner:
                here = part == k
                leaf[here] += self.inner[k].own(x[here]).argmax(axis=1)
        return leaf

    def ordered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of each row, most probable first, and the probability of those before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        own = np.take_along_axis(p, order, axis=1)
        return order, own.cumsum(axis=1) - own


def mass_for(router: Router, rows: np.ndarray, queries: np.ndarray, recall: float, k: int = 5) -> float:
    """The least probability that visited leaves must hold so that the k nearest rows of the queries are found at ``recall``."""
    filed = router.filed(rows)
    nearest = np.argsort(-(queries @ rows.T), axis=1, kind="stable")[:, :k]
    order, before = router.ordered(queries)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.take_along_axis(before, np.take_along_axis(place, filed[nearest], axis=1), axis=1)
    return float(np.quantile(needed, recall)) + 1e-9


def fit_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30, seed: int = 7) -> Router:
    """Cross-entropy against the parts of a row and of its neighbours, by Adam on small batches."""
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x))[:, None], part[graph]), 1.0)
    target[np.arange(len(x)), part] += graph.shape[1] / 2
    target /= target.sum(axis=1, keepdims=True)
    dims = x.shape[1]
    theta = [rng.normal(0, (2 / dims) ** 0.5, (dims, hidden)) * 3, np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.004 * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(x), 128):
            i = order[a : a + 128]
            h = np.maximum(x[i] @ theta[0] + theta[1], 0)
            z = h @ theta[2] + theta[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[i]) / len(i)
            dh = (d @ theta[2].T) * (h > 0)
            step += 1
            for t, (value, g) in enumerate(zip(theta, (x[i].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)), strict=True)):
                m[t] = 0.9 * m[t] + 0.1 * g
                v[t] = 0.999 * v[t] + 0.001 * g * g
                value -= rate * (m[t] / (1 - 0.9**step)) / (np.sqrt(v[t] / (1 - 0.999**step)) + 1e-8)
    return Router(*theta)


def parts_for(rows: int, most: int = MOST_PARTS) -> int:
    """The power of two next to sqrt(rows) / 2, at least 2 and at most ``most``."""
    return int(np.clip(2 ** round(np.log2(max(1.0, rows**0.5 / 2))), 2, most))


def fit_parts(x: np.ndarray, parts: int, neighbours: int = 12) -> Router:
    """A router from unit vectors alone: graph, balanced cut, network."""
    graph = neighbour_graph(x, min(neighbours, len(x) - 1))
    return fit_router(x, balanced_parts(x, graph, parts), graph, parts)


def _inner(parts: int, dims: int, sample_rows: int):
    """For the drawn rows of one part: its number and the arrays of a router over ``parts`` leaves."""
    schema = ("part", "w1", "b1", "w2", "b2")

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "row_id"], ignore_index=True).iloc[:sample_rows]
        if len(rows) < 8 * parts:
            return pd.DataFrame({n: [] for n in schema})
        x = matrix(rows["vector"], dims)
        r = fit_parts(x / np.linalg.norm(x, axis=1, keepdims=True), parts)
        return pd.DataFrame({"part": [key[0]], **{n: [getattr(r, n).astype(np.float32).tobytes()] for n in schema[1:]}})

    return fitted


def fit_index(vectors: DataFrame, total: int, dims: int, sample_rows: int = 12_288, parts: int | None = None, recall: float = 0.95, leaf: int = LEAF, inner_rows: int = 2048) -> Router | None:
    """The router, learnt from at most about ``sample_rows`` vectors of length ``dims`` drawn by a hash of the row.

    An eighth of the sample is held out to set the probability that visited leaves must hold for the target recall. Inner
    routers are learnt in tasks, from at most ``inner_rows`` vectors of each of at most MOST_PARTS parts, and have at most 64
    leaves; together they are at most some 20 MB for 64 dimensions.

    None (a single part) if there are fewer than 16 vectors: two parts could not hold five neighbours each.
    """
    hashed = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "row_id", "vec_id"), F.lit(1 << 30))
    of_length = vectors.where(F.size("vector") == dims)
    drawn = of_length.where(hashed(11) < int(min(1.0, sample_rows / max(1, total)) * (1 << 30)))
    sample = drawn.orderBy("row_id").limit(2 * sample_rows).select("vector").toPandas()
    if len(sample) < 16:
        return None
    x = matrix(sample["vector"], dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held = np.arange(len(x)) % 8 == 0
    learnt, asked = x[~held], x[held]
    parts = max(2, min(parts or parts_for(total), 2 ** int(np.log2(len(learnt) / 6))))
    router = fit_parts(learnt, parts)
    leaves = int(min(64, 2 ** np.ceil(np.log2(max(1.0, total / parts / leaf)))))
    if leaves > 1:
        # about twice inner_rows of each part
        thinned = of_length.where(hashed(12) < int(min(1.0, 2 * inner_rows * parts / total) * (1 << 30))).select("row_id", "vector", hashed(13).alias("h"))
        placed = thinned.mapInPandas(_file(router), "row_id bigint, vector array<double>, h bigint, part bigint")
        # the rows of a part that a task takes are bounded by their rank, even in a crowded part
        nth = F.row_number().over(Window.partitionBy("part").orderBy("h", "row_id"))
        bounded = placed.withColumn("nth", nth).where(F.col("nth") <= inner_rows).drop("nth")
        found = bounded.groupBy("part").applyInPandas(_inner(leaves, dims, inner_rows), "part bigint, w1 binary, b1 binary, w2 binary, b2 binary")
        for r in found.toPandas().itertuples():
            w1, b1, w2, b2 = (np.frombuffer(v, np.float32).astype(np.float64) for v in r[2:6])
            router.inner[int(r.part)] = Router(w1.reshape(dims, -1), b1, w2.reshape(len(b1), -1), b2)
    router.mass = mass_for(router, learnt, asked, recall)
    return router


def _file(router: Router | None):
    """Most probable leaf of every row, as part."""

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = np.zeros(len(b), np.int64)
            if router is not None and len(b):
                dims = len(router.w1)
                fits = b["vector"].map(len).to_numpy() == dims
                x = matrix(b["vector"][fits], dims)
                part[fits] = router.filed(x / np.linalg.norm(x, axis=1, keepdims=True))
            yield b.assign(part=part)

    return filed


def _route(router: Router | None, sizes: dict[int, int], least: int):
    """A row for each leaf that a query visits: the most probable until they hold the router's mass and ``least`` rows."""

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if router is None or not len(b):
                yield b.assign(part=np.zeros(len(b), np.int64))
                continue
            dims = len(router.w1)
            fits = b["vector"].map(len).to_numpy() == dims
            other, b = b[~fits], b[fits]
            if len(other):
                yield other.assign(part=np.zeros(len(other), np.int64))
            for first in range(0, len(b), AT_ONCE):
                own = b.iloc[first : first + AT_ONCE]
                x = matrix(own["vector"], dims)
                order, mass = router.ordered(x / np.linalg.norm(x, axis=1, keepdims=True))
                held = np.array([sizes.get(p, 0) for p in range(order.shape[1])])[order]
                before = held.cumsum(axis=1) - held
                q, place = np.nonzero(((mass < router.mass) | (before < least)) & (held > 0))
                yield own.iloc[q].assign(part=order[q, place])

    return routed


def _rank(k: int):
    names = ("row_id", "query_id", "candidate", "vec_id")

    def ranked(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names} | {"score": pd.Series(dtype="float64")})
        rows = rows.sort_values(["vec_id", "row_id"], ignore_index=True)
        dims = len(rows["vector"].iloc[0])
        b = matrix(rows["vector"], dims)
        lengths, own, ids = np.linalg.norm(b, axis=1), rows["row_id"].to_numpy(), rows["vec_id"].to_numpy()
        out = []
        for first in range(0, len(queries), AT_ONCE):
            part = queries.iloc[first : first + AT_ONCE]
            a = matrix(part["vector"], dims)
            scores = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / lengths[None, :]
            scores[part["row_id"].to_numpy()[:, None] == own[None, :]] = -np.inf
            if len(ids) > k:
                # everything at or above the k-th score, then the first k of a stable order: ties go to the smaller id
                at = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                q, c = np.nonzero((scores >= at[:, None]) & (scores > -np.inf))
            else:
                q, c = np.nonzero(scores > -np.inf)
            s = scores[q, c]
            order = np.lexsort((c, -s, q))
            q, c, s = q[order], c[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            found = (part["row_id"].to_numpy()[q[keep]], part["query_id"].to_numpy()[q[keep]], own[c[keep]], ids[c[keep]])
            out.append(pd.DataFrame(dict(zip(names, found, strict=True)) | {"score": s[keep]}))
        return pd.concat(out, ignore_index=True)

    return ranked


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, least_rows: int = 128, **fit) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the k nearest found of each query, ties to the smaller vec_id.

    ``vectors``: row_id, vec_id, vector; ``queries``: row_id, query_id, vector; no vector is zero. A row with the query's
    row_id is no candidate, nor is a vector of another length; other rows of the query's id are. Without row_id ids are taken
    to be unique. A query visits leaves that hold ``least_rows`` rows or more. Leaves are split by a hash of the row into
    blocks of bounded size, so a crowded one is no hot group. No query or no vector gives no rows; other columns are ignored.
    """
    vectors, queries = with_row_id(vectors, "vec_id"), with_row_id(queries, "query_id")
    shape = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    router = fit_index(vectors, shape[0]["n"], shape[0]["dims"], **fit) if shape else None
    filed = vectors.mapInPandas(_file(router), "row_id bigint, vec_id bigint, vector array<double>, part bigint")
    # one entry for each leaf, at most 64 * MOST_PARTS
    sizes = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    routed = queries.mapInPandas(_route(router, sizes, least_rows), "row_id bigint, query_id bigint, vector array<double>, part bigint")
    asked = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    spark = vectors.sparkSession
    blocks = [(int(p), max(1, -(-sizes.get(p, 0) // BLOCK_ROWS)), max(1, -(-asked.get(p, 0) // BLOCK_QUERIES))) for p in {0, *sizes, *asked}]
    known = F.broadcast(spark.createDataFrame(blocks, "part bigint, row_blocks int, query_blocks int"))
    split = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["part", "rb", "qb", "dims"]
    left = routed.join(known, "part").select("row_id", "query_id", "vector", "part", split("query_blocks").alias("qb"), F.size("vector").alias("dims"), every("row_blocks").alias("rb"))
    right = filed.join(known, "part").select("row_id", "vec_id", "vector", "part", split("row_blocks").alias("rb"), F.size("vector").alias("dims"), every("query_blocks").alias("qb"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_rank(k), "row_id bigint, query_id bigint, candidate bigint, vec_id bigint, score double")
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "vec_id", "candidate")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of every embeddings row whose vec_id is divisible by 50, against all other rows."""
    vectors = usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).where(F.exists("vector", lambda x: x != 0))
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), k=5)
