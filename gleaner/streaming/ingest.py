"""Incremental ingest and request monitoring as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.text import content_hash


def new_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_contents(stream: DataFrame, at: str = "ts", delay: str = "1 hour", text: str = "text") -> DataFrame:
    """First sight of each content within the watermark."""
    return stream.withColumn("content_hash", content_hash(text)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])


def upsert_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch goes to ``merge(batch, epoch)``, which writes the next snapshot; a replayed epoch must be idempotent."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_windows(events: DataFrame, at: str = "ts", width: str = "1 day", delay: str | None = None, kind: str = "event_type", value: str = "value") -> DataFrame:
    """Requests by tumbling window and kind; the same plan for tables and streams (give ``delay`` for a stream)."""
    rows = events.withWatermark(at, delay) if delay else events
    return rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, at: str = "ts", gap: str = "30 minutes", user: str = "user_id", delay: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, delay) if delay else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
