"""Windows over the event log that hold for batches and streams alike, and resumable streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by type in windows of one width; ``late`` bounds how late a stream's events may be."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events with no pause as long as the gap."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last call, exactly once, then stop: the resumable form of a batch ingest."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def first_seen(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the bound on lateness: skip-first state for a stream."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
