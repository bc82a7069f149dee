"""The batch session and count rules over unbounded input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def stream_sessionize(events: DataFrame, user: str, ts: str, gap: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """``(user, first, last, n)`` per session, emitted once the watermark has passed it.

    A session ends after a gap of more than ``gap``, as in the batch rule. Only open sessions are kept
    as state, one small row each.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return (
        timed.groupBy(F.col(user), F.session_window("_ts", gap))
        .agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.count(F.lit(1)).alias("n"))
        .select(user, "first", "last", "n")
    )


def stream_unigrams(events: DataFrame, token: str, ts: str, window: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """Token counts per time window; rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    counts = timed.groupBy(F.window("_ts", window).alias("w"), F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "token", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work through everything that is there now, append what is complete, and stop."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
