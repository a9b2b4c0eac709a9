"""Structured Streaming over folders and events (an extension: the batch operators on micro-batches)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def drain_folder(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet", files: int = 1000) -> StreamingQuery:
    """Process what a folder holds now, once each over all runs with this checkpoint."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, late: str, width: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` by time window and keys; rows later than ``late`` are dropped on streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
