"""Mixing against a plain earliest-deadline-first loop over windows of the exact weights."""

from __future__ import annotations

import heapq
from fractions import Fraction

import duckdb
import pytest

from brandlens.llm import source_mix


def plain(parts: dict[int, int], blocks: dict[int, int]) -> dict[tuple[int, int], int]:
    """(source, block) -> slot by one loop over the slots."""
    whole = sum(parts.values())
    jobs = sorted((b * whole // p, -(-(b + 1) * whole // p), s, b) for s, p in parts.items() for b in range(blocks[s]))
    ready: list[tuple[int, int, int]] = []
    out, slot, at = {}, 0, 0
    while at < len(jobs) or ready:
        if not ready:
            slot = max(slot, jobs[at][0])
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        due, s, b = heapq.heappop(ready)
        assert slot < due
        out[s, b] = slot
        slot += 1
    return out


@pytest.mark.parametrize(
    ("weights", "slots"),
    [
        ([0.31, 0.2, 0.17, 0.11, 0.09, 0.07, 0.03, 0.02], 9000),
        ([0.9995, 0.0005], 8000),
        ([0.5 - 1e-4, 0.5 - 1e-4, 2e-4], 12000),
        ([1.0], 50),
        ([0.4] + [0.6 / 399] * 399, 5000),
    ],
)
def test_schedule_is_the_plain_loop_and_less_than_a_block_off(spark, weights, slots):
    blocks = [int(w * slots * (0.3 if i % 3 == 1 else 1)) + 1 for i, w in enumerate(weights)]
    quotas = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(zip(weights, blocks, strict=True))], "source_no int, w double, n bigint")
    parts = {r.source_no: r.parts for r in source_mix.weight_parts(quotas, 300, 1).collect()}
    got = {(r.source_no, r.block): r.slot for r in source_mix.whole_schedule(quotas, 300, 1).collect()}
    assert got == plain(parts, dict(enumerate(blocks)))
    # below one block exactly for the whole parts, which are the given weights but for rounding
    for (s, b), slot in got.items():
        share = Fraction(parts[s], sum(parts.values()))
        assert abs(share - Fraction(weights[s]) / sum(map(Fraction, weights))) < Fraction(len(weights), 1 << 39)
        assert abs(b - share * slot) < 1 and abs(b + 1 - share * (slot + 1)) < 1


def test_many_sources_keep_their_weights(spark):
    rows = [(i, 1.0 + i % 7, 34) for i in range(3000)]
    quotas = spark.createDataFrame(rows, "source_no int, w double, n bigint")
    got = source_mix.whole_schedule(quotas, 1000, 1).collect()
    total = sum(w for _, w, _ in rows)
    assert len(got) == 3000 * 34 == len({r.slot for r in got})
    assert all(abs(r.block - rows[r.source_no][1] / total * r.slot) < 1 for r in got)


def test_sources_of_no_weight_come_last(spark):
    docs = spark.createDataFrame([(i, s) for s in "abc" for i in range(40)], "doc_id int, source string")
    out = source_mix.mix_sources(docs, {"a": 0.75, "b": 0.25, "c": 0.0}, block_rows=1).collect()
    assert len(out) == 120 == len({r.mix_slot for r in out})
    assert min(r.mix_slot for r in out if r.source == "c") > max(r.mix_slot for r in out if r.source != "c")


def test_query_equals_its_sql_on_skewed_sources(spark, tmp_path):
    docs = [(i, "x", "l", s, 1) for i, s in enumerate(["hot"] * 900 + ["a"] * 200 + ["b"] * 31 + [None] * 17 + [f"s{k}" for k in range(9)])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = source_mix.op1_mixing_sources(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(source_mix.OP1_SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))
