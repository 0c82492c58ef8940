"""Readers of record files, and a generator of synthetic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.errors import SerializationError

_JSON = "id STRING, vector ARRAY<DOUBLE>, text STRING, payload STRING, _bad STRING"


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of ``{"id", "vector", "text"?, "payload"?}`` lines, and the lines that aren't such (``_bad``).

    Blank lines are neither. strict: reading a bad line fails. A missing payload is ``{}``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.withColumn("r", F.from_json("value", _JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("r._bad").isNull() & F.col("r.id").isNotNull() & F.col("r.vector").isNotNull() & ~F.exists("r.vector", lambda x: x.isNull())
    good = F.coalesce(good, F.lit(False))
    if strict:
        rows = rows.withColumn("r", F.when(good, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("value")))))
        return _records(rows), lines.select(F.col("value").alias("_bad")).limit(0)
    return _records(rows.where(good)), rows.where(~good).select(F.col("value").alias("_bad"))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select("r.id", F.col("r.vector").cast("array<float>").alias("vector"), "r.text", F.coalesce("r.payload", F.lit("{}")).alias("payload"))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of a CSV file with the columns ``id``, ``vector`` (JSON array) and perhaps ``text``, and the bad rows."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    if not {"id", "vector"} <= set(rows.columns):
        raise SerializationError(f"no columns id and vector in {rows.columns}")
    v = F.from_json("vector", "array<double>")
    good = F.coalesce(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()), F.lit(False))
    text = F.col("text") if "text" in rows.columns else F.lit(None).cast("string")
    return rows.where(good).select("id", v.cast("array<float>").alias("vector"), text.alias("text"), F.lit("{}").alias("payload")), rows.where(~good)


def ingest(spark: SparkSession, path: str, collection=None, dry_run: bool = False) -> dict[str, int]:
    """Reads a ``.jsonl`` or ``.csv`` file into a collection; with dry_run (or without collection) only counts."""
    read = read_csv if str(path).endswith(".csv") else read_jsonl
    records, bad = read(spark, path)
    summary = {"read": records.count(), "skipped": bad.count(), "written": 0}
    if collection is not None and not dry_run:
        summary["written"] = collection.insert_frame(records)
    return summary


def read_vecs(spark: SparkSession, path: str, dimension: int, kind: str = "f") -> DataFrame:
    """``i, vector`` of a file of ``u32 dimension`` and that many ``f32`` (``kind`` f) or ``u32`` (i) each; its records have
    one length, so the file is split between tasks."""
    rows = spark.sparkContext.binaryRecords(path, 4 + 4 * dimension).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    element, dtype = ("FLOAT", "<f4") if kind == "f" else ("BIGINT", "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column("b").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            if (raw[:, :4].copy().view("<u4") != dimension).any():
                raise ValueError(f"a record hasn't {dimension} dimensions")
            x = np.ascontiguousarray(raw[:, 4:]).view(dtype).astype(np.float32 if kind == "f" else np.int64)
            offsets = pa.array(np.arange(0, x.size + 1, dimension, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["i", "vector"])

    return spark.createDataFrame(rows, "i BIGINT, b BINARY").mapInArrow(decode, f"i BIGINT, vector ARRAY<{element}>")


def synthetic(spark: SparkSession, rows: int, dimension: int = 128, seed: int = 42) -> DataFrame:
    """``id, vector``: ``syn-{i}``, uniform in [-1, 1) and scaled to length one; the same however it is partitioned."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            x = np.stack([np.random.default_rng((seed, i)).uniform(-1, 1, dimension) for i in ids]) if ids else np.zeros((0, dimension))
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            offsets = pa.array(np.arange(0, x.size + 1, dimension, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([f"syn-{i}" for i in ids]), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["id", "vector"])

    return spark.range(rows).mapInArrow(generate, "id STRING, vector ARRAY<FLOAT>")


def write_records(records: DataFrame, path: str, fields: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet sink; declared payload fields become columns of their own, which scans can skip by."""
    from brindle.functions.filters import hoist

    hoist(records, list(fields)).write.mode(mode).parquet(path)
