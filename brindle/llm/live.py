"""Current state of the exported record table, and vectors in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

DIM = 64


def live_records(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """Latest row of every id, without deleted ones: ``id`` and ``columns``.

    Of rows with equal ``updated_at`` a tombstone wins, then the larger content hash, so that the result doesn't depend
    on the order of rows. A NULL ``updated_at`` is older than any other, a NULL ``deleted`` counts as deleted, and rows
    without id are no records.
    """
    order = F.struct("updated_at", F.coalesce("deleted", F.lit(1)).alias("d"), F.xxhash64(*columns).alias("h"))
    latest = (
        vectors.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(F.struct(F.coalesce("deleted", F.lit(1)).alias("_deleted"), *columns), order).alias("r"))
    )
    return latest.where("r._deleted = 0").select("id", *[F.col(f"r.{c}").alias(c) for c in columns])


def usable(vector: str | Column, dim: int = DIM) -> Column:
    """Vector with ``dim`` elements, none NULL or NaN, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float32) -> np.ndarray:
    """List column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=dtype)
    return flat.reshape(n, -1) if n else np.zeros((0, DIM), dtype)


def lists(m: np.ndarray) -> pa.Array:
    """Matrix as a list column."""
    m = np.ascontiguousarray(m)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32)[: len(m) + 1]), pa.array(m.ravel()))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; computed in double."""
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def portions(batch: pa.RecordBatch, text: str, rows: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``chars`` bytes of text, one row at least, so that long texts don't fill a
    worker's memory with words."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + chars, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def sample(df: DataFrame, n: int, rows: int, id_col: str = "id") -> DataFrame:
    """About ``rows`` of the ``n`` rows, chosen by a hash of the id; all if there are no more."""
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1_000_000)) < int(np.ceil(1e6 * rows / n)))
