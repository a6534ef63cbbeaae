"""The searches against brute force: large components, repeated ids, recall of the registered query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brandlens.llm import exact_topk, vectors
from brandlens.llm.registry import QUERIES


def search(spark, rows, kind="double"):
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    whole = exact_topk.whole_vectors(vectors.usable_vectors(table))
    got = exact_topk.top_k(whole, whole.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5)
    return sorted(tuple(r) for r in got.collect())


def plain(rows):
    """Exact integers; the row itself is no candidate, other rows of its id are."""
    held = [(k, i, [int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(256 * x) for x in v]) for k, (i, v) in enumerate(rows)]
    fit = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for k, q, a in held:
        if q % 50 == 0:
            found = sorted((-fit(sum(x * y for x, y in zip(a, b, strict=True))), i) for j, i, b in held if j != k)[:5]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e9, 1e20, 1e300])
def test_components_of_any_size(spark, scale):
    r = np.random.default_rng(7)
    rows = [(i, (r.normal(0, 1, 6) * (scale if i % 4 == 0 else 1.0)).tolist()) for i in range(150)]
    rows += [(50, [scale, -scale, 1.0, 0.0, 0.0, 0.0]), (200, [scale, scale, 3.0, 0.0, 0.0, 0.0])]
    assert search(spark, rows) == plain(rows)


def test_rows_of_one_id_are_candidates_each(spark):
    r = np.random.default_rng(8)
    rows = [(i % 60, r.normal(0, 0.3, 8).round(3).tolist()) for i in range(180)] + [(3, [9.0] * 8), (0, [1.0] * 8), (0, [1.0] * 8)]
    assert search(spark, rows) == plain(rows)


def cosines(x, got):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for row in got:
        found.setdefault(row.query_id, []).append(row)
    hits = []
    for q in range(0, len(x), 50):
        s = unit @ unit[q]
        s[q] = -9
        own = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        for r in own:
            assert r.score == pytest.approx(float(s[r.vec_id]), abs=1e-12)
        hits.append(len({r.vec_id for r in own} & set(np.argsort(-s)[:5].tolist())) / 5)
    return float(np.mean(hits))


@pytest.mark.parametrize("rows", [600, 4000])
def test_recall_of_the_registered_query(spark, tmp_path, rows):
    x = np.random.default_rng(9).normal(0, 1, (rows, 48))
    frame = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    odd = spark.createDataFrame([(50, None, 1), (100, [0.0] * 48, 1), (150, [float("nan")] * 48, 1), (None, [1.0] * 48, 1), (7, [1.0, 2.0], 1)], frame.schema)
    frame.unionByName(odd).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert cosines(x, QUERIES["op10_ann"](spark, str(tmp_path)).collect()) >= 0.9


def test_parts_are_cut_again(spark):
    from brandlens.llm import ann

    x = np.random.default_rng(10).normal(0, 1, (5000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, vector array<double>").withColumn("part", F.lit("clash"))
    router = ann.fit_index(vectors.with_row_id(frame, "vec_id"), 5000, 32, parts=8, leaf=128)
    assert len(router.inner) == 8 and router.probabilities(x[:3]).shape[1] > 8
    assert router.probabilities(x[:50]).sum(axis=1) == pytest.approx(1.0)
    assert cosines(x, ann.nearest(frame, frame.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), parts=8, leaf=128).collect()) >= 0.9
    assert [ann.parts_for(n) for n in (10, 500, 10_000, 10**6, 10**12)] == [2, 8, 64, 256, 256]


def test_repeated_rows_are_neighbours(spark):
    from brandlens.llm import ann

    rows = [(i, np.random.default_rng(i).normal(0, 1, 8).tolist()) for i in range(40)] + [(0, np.random.default_rng(0).normal(0, 1, 8).tolist())] * 2
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    usable = vectors.usable_vectors(table)
    got = ann.nearest(usable, usable.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")).collect()
    assert len(got) == 15 and all(r.vec_id == 0 for r in got if r["rank"] <= 2)
