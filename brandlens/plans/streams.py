"""Registered queries that run a stream over a bounded source to its end, each with the SQL of the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.plans.analytics import query
from brandlens.shared_files import new_shared_folder
from brandlens.sources.projection import Projection
from brandlens.streaming import live


def _drain(p: Projection, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's whole result once it has read all there is, written by the executors to a shared folder."""
    folder = new_shared_folder(p.spark)

    def write(batch: DataFrame, number: int) -> None:
        # complete: every batch is the whole result so far; append: every batch adds its own folder
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/batch={number}")

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", new_shared_folder(p.spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return p.spark.read.parquet(folder)


def _events(p: Projection) -> DataFrame:
    path = f"{p.sf_dir}/events.parquet"
    schema = p.spark.read.parquet(path).schema
    # a file source reads folders: a glob stands for a table of one file
    return p.spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_period_rollup", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _rollup(p: Projection) -> DataFrame:
    out = _drain(p, live.period_rollup(_events(p), "ts", ["event_type"]), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("stream_throttle", "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, count(*) > 1 AS over FROM events GROUP BY 1, 2")
def _throttle(p: Projection) -> DataFrame:
    out = _drain(p, live.throttle_counts(_events(p), "ts", ["event_type"], 1), "complete")
    return out.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _first(p: Projection) -> DataFrame:
    return _drain(p, live.first_seen(_events(p), "ts", ["user_id", "event_type"], "60 days"), "append").select("user_id", "event_type")


def _event_files(p: Projection, files: int = 6) -> DataFrame:
    """The events as a stream of several files, one a batch."""
    folder = new_shared_folder(p.spark)
    events = p.table("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    events.repartitionByRange(files, "at").write.parquet(folder)
    return p.spark.readStream.schema(p.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("stream_first_ever", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def _first_ever(p: Projection) -> DataFrame:
    return _drain(p, live.first_ever(_event_files(p), "at", ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("stream_keyed_spans", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def _keyed_spans(p: Projection) -> DataFrame:
    folder, key = new_shared_folder(p.spark), ["user_id", "event_type"]
    run = _event_files(p).writeStream.foreachBatch(live.keyed_spans(folder, key, compact_every=2)).option("checkpointLocation", new_shared_folder(p.spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return live.read_spans(p.spark, folder, key).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})
