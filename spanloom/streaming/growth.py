"""Streaming forms: new annotation batches from a folder, windowed counts with late data, first-seen keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_batches(spark: SparkSession, path: str, schema: str, per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """A6 as a stream: files are taken as they arrive, at most ``per_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and keys; windows close when the watermark has passed."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """G12 as a stream: a row for each key at its first arrival within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Processes what is there, exactly once across restarts, and stops."""
    return stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
