"""The filters over streams of reads, and counts over windows of time.

A filter is a DataFrame -> DataFrame function of rows, so it runs on a stream as it does on a table. Duplicates among reads that arrive late need bounded
state: an event's key is remembered until the watermark has passed it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def filtered(reads: DataFrame, filters: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for f in filters:
        reads = reads.transform(f)
    return reads


def written(reads: DataFrame, path: str, checkpoint: str, all_now: bool = True) -> StreamingQuery:
    """Appended to a Parquet folder, exactly once."""
    writer = reads.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if all_now else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day", value: Column | None = None) -> DataFrame:
    """start, key, n, total of each window (sliding, if slide is given); rows that come later than `late` are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late) if events.isStreaming else events
    return out.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value if value is not None else F.lit(0.0)).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """start, end, key, n of each session: events of a key with no longer gaps than `gap`."""
    out = events.withWatermark(time, late) if events.isStreaming else events
    return out.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
