"""Structured Streaming over decision logs: an extension, as the single-process loop has no streams.

The same functions take batch and streaming tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "ts timestamp, episode bigint, step bigint, action string, reward double"


def log_of(events: DataFrame) -> DataFrame:
    """Events as a decision log; their time gets a zone, which watermarks need."""
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("episode"), F.col("event_id").alias("step"), F.col("event_type").alias("action"), F.col("value").alias("reward"))


def read_log(spark: SparkSession, path: str, *, per_trigger: int = 100) -> DataFrame:
    """A log folder of JSON lines as a stream."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", per_trigger).json(path)


def rewards_by_window(log: DataFrame, width: str, *, late: str = "1 hour") -> DataFrame:
    """``start, end, action, n, reward`` in tumbling windows; rows later than ``late`` are dropped by a stream only."""
    if log.isStreaming:
        log = log.withWatermark("ts", late)
    sums = log.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("reward"))
    return sums.select("w.start", "w.end", "action", "n", "reward")


def sessions(log: DataFrame, gap: str, *, late: str = "1 hour") -> DataFrame:
    """``episode, start, end, n, reward`` of runs of steps without a longer gap."""
    if log.isStreaming:
        log = log.withWatermark("ts", late)
    sums = log.groupBy(F.session_window("ts", gap).alias("w"), "episode").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("reward"))
    return sums.select("episode", "w.start", "w.end", "n", "reward")


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and append it as Parquet.

    The batch number is part of the path and a batch overwrites its own folder, so
    one that is run again after a failure leaves no row twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
