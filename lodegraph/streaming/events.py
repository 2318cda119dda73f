"""Structured Streaming forms of the event aggregates; the same functions run on batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import upsert


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by window; on a stream, events later than `late` are dropped by the watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): sessions of a user, ended by `gap` without events."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def run_once(spark: SparkSession, source: str, transform, target: str, checkpoint: str, mode: str = "append") -> None:
    """Streams what is new in the Parquet folder `source` through `transform` into `target`, then stops."""
    schema = spark.read.parquet(source).schema
    q = transform(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def merge_runtime(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Keeps a table of the latest statistics by (name, source): each micro-batch is merged by last write."""
    schema = spark.read.parquet(source).schema

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("name", "trace_source").agg(F.max_by(F.struct("call_count", "error_rate"), "seen").alias("s"), F.max("seen").alias("seen")).select("name", "trace_source", "s.*", "seen")
        side = f"{target}-{number % 2}"
        before = f"{target}-{(number + 1) % 2}"
        old = spark.read.schema(new.schema).parquet(before) if number else spark.createDataFrame([], new.schema)
        upsert(old, new, ["name", "trace_source"], "seen").write.mode("overwrite").parquet(side)

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
