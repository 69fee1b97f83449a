"""Incremental ingest on Structured Streaming: new files once each, late and repeated events, per-key state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_seen(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events without repeats of a key within the watermark; state older than it is dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Count and sum by event type and tumbling or sliding window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    out = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def ingest_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is new since the last run, then end; a file is read once, whatever fails in between."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_states(listing: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """status of each listed file: completed, failed or pending."""
    d, f = done.select("path", F.lit(True).alias("d")).distinct(), failed.select("path", F.lit(True).alias("f")).distinct()
    return listing.join(d, "path", "left").join(f, "path", "left").withColumn("status", F.when(F.col("d"), "completed").when(F.col("f"), "failed").otherwise("pending")).drop("d", "f")
