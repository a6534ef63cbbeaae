"""Structured Streaming forms of period roll-ups, novelty and throttling. The batch operators remain authoritative."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def period_rollup(events: DataFrame, at: str, keys: list[str], width: str = "7 days", anchor: str = "0 days", late: str = "1 day") -> DataFrame:
    """Counts and mean value per window and key; late rows up to ``late`` behind count. ``anchor`` shifts windows off the epoch."""
    window = F.window(F.col(at), width, startTime=anchor)
    counted = events.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean_value")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: new sources or claims as they come."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def throttle_counts(requests: DataFrame, at: str, keys: list[str], limit: int) -> DataFrame:
    """Requests per minute and key, and whether they are over the limit."""
    counted = requests.withWatermark(at, "1 minute").groupBy(F.window(F.col(at), "1 minute").alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("minute"), *keys, "n", (F.col("n") > limit).alias("over"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Novelty(StatefulProcessor):
    """Remembers that a key was seen, and when first; says so once."""

    def __init__(self, keys: list[str], at: str, ttl_ms: int | None) -> None:
        self._keys, self._at, self._ttl_ms = keys, at, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "at timestamp", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a batch's rows of a key come in parts; only the least time is kept
        times = [x for x in (r[self._at].min() for r in rows) if not pd.isna(x)]
        if not self._first.exists():
            first = min(times) if times else None
            self._first.update((None if first is None else first.to_pydatetime(),))
            yield pd.DataFrame({**{k: [v] for k, v in zip(self._keys, key, strict=True)}, "first_at": pd.Series([first], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def first_ever(events: DataFrame, at: str, keys: list[str], ttl: timedelta | None = None) -> DataFrame:
    """``keys`` and first_at of each key, once, in the batch that brings it: late rows and restarts don't make it new again.

    State is a time for each key and lies in RocksDB, so it may outgrow memory; with ``ttl`` a key that was new longer ago
    than that (in processing time) is forgotten and can be new again, and the query runs until it is stopped. first_at is the least time among the key's rows of
    its first batch. Null is a key like any other.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fields = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    processor = _Novelty(keys, at, None if ttl is None else int(ttl.total_seconds() * 1000))
    # without state that expires no timer is needed
    mode = "None" if ttl is None else "ProcessingTime"
    return events.select(*keys, F.col(at).cast("timestamp").alias(at)).groupBy(*keys).transformWithStateInPandas(processor, f"{fields}, first_at timestamp", "Append", mode)


def _spans(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def keyed_spans(path: str, key: list[str], compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of first_seen and last_seen (of column ``at``) of each key that writes only what a batch brings.

    Each batch is a delta of its own, named by its number, so a batch that is run again replaces its delta and nothing
    else; numbers may skip, and the path may hold deltas of an earlier query. Every ``compact_every``-th batch also merges
    all so far to a new base. Spans merge by least and greatest, so any order and repetition gives the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy(*key).agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
        fresh.write.mode("overwrite").parquet(f"{path}/kind=delta/n={number}")
        if number and number % compact_every == 0:
            read_spans(batch.sparkSession, path, key, number).write.mode("overwrite").parquet(f"{path}/kind=base/n={number}")

    return write


def read_spans(spark: SparkSession, path: str, key: list[str], before: int | None = None) -> DataFrame:
    """key, first_seen, last_seen of all that keyed_spans has written: the newest base and the deltas after it.

    With ``before``, only bases of smaller numbers count (a compaction does not read the one it writes).
    """
    every = spark.read.option("basePath", path).parquet(path)
    bases = every.where("kind = 'base'")
    if before is not None:
        bases = bases.where(F.col("n") < before)
    newest = bases.agg(F.max("n").alias("n")).first()["n"]
    if newest is None:
        return _spans(every.where("kind = 'delta'"), key)
    return _spans(every.where(((F.col("kind") == "base") & (F.col("n") == newest)) | ((F.col("kind") == "delta") & (F.col("n") > newest))), key)
