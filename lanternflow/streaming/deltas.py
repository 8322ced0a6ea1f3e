"""Extension: streams of events. Windowed counts with late data bounded by a watermark, and deltas for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_mix(events: DataFrame, at: str = "ts", category: str = "event_type", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """window_start, category, n: works on streams and on tables alike."""
    counted = events.withWatermark(at, late) if events.isStreaming else events
    return counted.groupBy(F.window(at, width), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "category", "n")


def per_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls handle with each batch of the available data, then ends. handle must be idempotent for a batch id."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
