"""The task log as a stream: windowed counts with a watermark, a stateful limiter, first deliveries.

Each function takes a streaming DataFrame and returns one; ``drained`` runs a finite
source to its end, so that the same transformations serve files and live sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.folds import COOLDOWN_SQL
from quire.plans.registry import query
from quire.sources.scratch import scratch_path
from quire.sources.tables import TASKS_SQL, status, table


def events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event files as a stream, a bounded number of files at a time if asked."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(f"{sf_dir}/events.parquet*")  # a pattern may match one file or a folder; a plain path must be a folder


def drained(stream: DataFrame) -> DataFrame:
    """What a stream emits until its source is exhausted; rows and state lie in the shared folder."""
    spark = stream.sparkSession
    base = scratch_path(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def hourly_status(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tasks by hour and status; an hour is emitted once the watermark has passed its end."""
    e = stream.select(F.col("ts").cast("timestamp").alias("ts"), status(F.col("event_type")).alias("status"))
    counts = e.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "status").agg(F.count("*").alias("tasks"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "status", "tasks")


def cooldown(stream: DataFrame, window: int) -> DataFrame:
    """allowed per event: at least window seconds since the client's last allowed one, across triggers.

    The state of a client is one number. Rows of a client inside one trigger are put in order of event_id;
    maxFilesPerTrigger bounds them.
    """
    rows = stream.select(F.col("user_id").alias("ip"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("second"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = pd.concat(list(frames)).sort_values("seq")
        allowed = []
        for second in out["second"].tolist():
            fine = last is None or second - last >= window
            last = second if fine else last
            allowed.append(fine)
        state.update((last,))
        yield out.assign(allowed=allowed)[["ip", "seq", "second", "allowed"]]

    return rows.groupBy("ip").applyInPandasWithState(run, "ip bigint, seq bigint, second bigint, allowed boolean", "last bigint", "append", "NoTimeout")


def first_deliveries(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """One row per client and kind of event; repeats within the watermark's reach are not delivered again."""
    e = stream.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", within)
    return e.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


@query(f"with s as ({TASKS_SQL}) select date_trunc('hour', created_at) as hour, status, count(*) as tasks from s where date_trunc('hour', created_at) + interval 1 hour <= (select max(created_at) from s) - interval 1 hour group by 1, 2")
def stream_hourly_status(spark, sf_dir):
    """Streaming counts of the hours that the watermark has closed."""
    return drained(hourly_status(events(spark, sf_dir)))


@query(COOLDOWN_SQL)
def stream_cooldown(spark, sf_dir):
    """The cooldown limiter of six hours as a stateful stream."""
    return drained(cooldown(events(spark, sf_dir), 21_600))


@query("select distinct user_id, event_type from events")
def stream_first_deliveries(spark, sf_dir):
    """Deliveries without repeats."""
    return drained(first_deliveries(events(spark, sf_dir)))
