"""Streams of operations on records, and their running state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.types import RECORD_SCHEMA

OPERATIONS = RECORD_SCHEMA + ", deleted INT"


def read_operations(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Stream of the operations that arrive as Parquet files in a folder."""
    return spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def deduplicated(operations: DataFrame, late: str = "1 day") -> DataFrame:
    """Each operation once; repetitions are recognised until the watermark passes their time."""
    return operations.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["id", "updated_at"])


def activity(operations: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``start, upserts, deletes`` of each window of ``updated_at``; rows later than the watermark are left out."""
    by = operations.withWatermark("updated_at", late).groupBy(F.window("updated_at", window))
    counts = by.agg(F.sum((F.col("deleted") == 0).cast("bigint")).alias("upserts"), F.sum((F.col("deleted") != 0).cast("bigint")).alias("deletes"))
    return counts.select(F.col("window.start").alias("start"), "upserts", "deletes")
