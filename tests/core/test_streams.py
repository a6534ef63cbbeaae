"""State that outlives restarts, late rows and skipped batches."""

import datetime
import time
from datetime import timedelta

from brandlens.streaming import live

ROWS = [[("a", "2024-01-05"), ("b", "2024-01-05"), ("a", "2024-01-04"), (None, "2024-01-05")], [("a", "2020-01-01"), ("c", "2024-02-01")], [], [("b", "2024-03-01"), (None, "2024-03-01"), ("d", None)]]


def batches(spark, folder, upto):
    for i, rows in enumerate(ROWS[:upto]):
        target = folder / f"f{i}"
        if not target.exists():
            spark.createDataFrame(rows, "k string, at string").selectExpr("k", "CAST(at AS TIMESTAMP) AS at").coalesce(1).write.parquet(str(target))
    return spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(stream, write, state):
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()


def test_a_key_is_new_once_whatever_comes_late_or_after_a_restart(spark, tmp_path):
    got = []
    write = lambda batch, number: got.extend((r.k, r.first_at and r.first_at.strftime("%Y-%m-%d")) for r in batch.collect())
    for upto in (2, 4):
        run(live.first_ever(batches(spark, tmp_path / "in", upto), "at", ["k"]), write, tmp_path / "state")
    assert sorted(got, key=str) == sorted([("a", "2024-01-04"), ("b", "2024-01-05"), (None, "2024-01-05"), ("c", "2024-02-01"), ("d", None)], key=str)


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    got = []
    write = lambda batch, number: got.extend(r.k for r in batch.collect())
    stream = live.first_ever(batches(spark, tmp_path / "in", 2), "at", ["k"], timedelta(milliseconds=1))
    # processing time has no end, so such a query is stopped
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    until = time.monotonic() + 60
    while len(got) < 5 and time.monotonic() < until and query.isActive:
        time.sleep(0.5)
    query.stop()
    assert sorted(got, key=str) == sorted(["a", "b", None, "a", "c"], key=str)


def test_spans_merge_over_restarts_repeats_and_skipped_numbers(spark, tmp_path):
    path, key = str(tmp_path / "spans"), ["k"]
    write = live.keyed_spans(path, key, compact_every=2)
    day = lambda text: datetime.datetime.fromisoformat(text)

    def batch(*rows):
        return spark.createDataFrame([(k, day(at)) for k, at in rows], "k string, at timestamp")

    write(batch(("a", "2024-01-05"), ("b", "2024-01-01")), 3)  # does not begin at 0
    write(batch(("a", "2024-01-02")), 4)  # compacts
    write(batch(("a", "2024-01-02")), 4)  # again
    write(batch(("c", "2024-01-09")), 7)  # skips numbers
    live.keyed_spans(path, key, compact_every=2)(batch(("a", "2023-12-31"), ("b", "2024-01-03")), 8)  # restarted, compacts
    write(batch(("c", "2024-01-01")), 9)
    got = {r.k: (r.first_seen, r.last_seen) for r in live.read_spans(spark, path, key).collect()}
    assert got == {"a": (day("2023-12-31"), day("2024-01-05")), "b": (day("2024-01-01"), day("2024-01-03")), "c": (day("2024-01-01"), day("2024-01-09"))}
