"""Inverted-file index: k-means lists, of which a query reads the nearest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.operators.knn import dense_search
from brindle.types import Metric


def _distances(x: np.ndarray, c: np.ndarray, metric: Metric) -> np.ndarray:
    if metric is Metric.DOT:
        return 1 - x @ c.T
    if metric is Metric.EUCLIDEAN:
        return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0)
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)
    return 1 - np.divide(x @ c.T, n, out=np.zeros((len(x), len(c))), where=n != 0)


@dataclass
class IvfIndex:
    centroids: np.ndarray
    metric: Metric

    @classmethod
    def train(cls, records: DataFrame, metric: Metric | str = Metric.COSINE, lists: int = 256, rounds: int = 25, vector: str = "vector", sample_rows: int = 100_000) -> "IvfIndex":
        """Lloyd's algorithm over the records in the order of their ids: the first centroids stand at equal distances in
        that order, a record goes to the first of the nearest, a centroid is its records' mean, an empty one takes the
        vector at place ``7 i``, and training ends when nothing moves by 1e-6. Of more than ``sample_rows`` records, about
        that many, chosen by a hash of the id, are used for training; every record is indexed."""
        m, n = Metric.of(metric), records.count()
        if n > sample_rows:
            records = records.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * sample_rows / n))
        rows = records.select("id", F.col(vector).cast("array<double>").alias("v")).toArrow().sort_by("id")
        n = len(rows)
        if not n:
            return cls(np.zeros((0, 1)), m)
        x = np.asarray(rows["v"].combine_chunks().flatten(), np.float64).reshape(n, -1)
        k = min(lists, n)
        c = x[np.arange(k) * (n // k)].copy()
        for _ in range(rounds):
            at = _distances(x, c, m).argmin(axis=1)
            count = np.bincount(at, minlength=k)
            new = np.zeros_like(c)
            np.add.at(new, at, x)
            empty = np.nonzero(count == 0)[0]
            new[count > 0] /= count[count > 0, None]
            new[empty] = x[(empty * 7) % n]
            still = np.abs(new - c).max() < 1e-6
            c = new
            if still:
                break
        return cls(c, m)

    def assign(self, records: DataFrame, vector: str = "vector") -> DataFrame:
        """``records`` with the list of each in ``cid``; of lists equally near, to nine digits, the first."""
        c, m = self.centroids, self.metric

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column(vector).flatten(), np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(_distances(x, c, m), 9).argmin(axis=1).astype(np.int32))], names=[*b.schema.names, "cid"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
        return records.mapInArrow(nearest, f"{schema}, cid INT")

    def probe(self, query: Sequence[float], lists: int = 16) -> list[int]:
        """The nearest lists (ties: smaller number)."""
        d = _distances(np.asarray(query, np.float64)[None], self.centroids, self.metric)[0]
        return np.argsort(d, kind="stable")[: min(lists, len(d))].tolist()

    def search(self, assigned: DataFrame, query: Sequence[float], k: int = 10, lists: int = 16, filter=None, vector: str = "vector") -> DataFrame:
        """Exact search within the nearest lists. On a table that is partitioned by ``cid`` only their files are read."""
        if not len(self.centroids):
            return dense_search(assigned, query, k, self.metric, filter, vector)
        return dense_search(assigned.where(F.col("cid").isin(self.probe(query, lists))), query, k, self.metric, filter, vector)

    def insert(self, assigned: DataFrame, records: DataFrame, vector: str = "vector") -> DataFrame:
        """``assigned`` with the given records in their lists; records of known ids are replaced."""
        return self.delete(assigned, records).unionByName(self.assign(records, vector))

    @staticmethod
    def delete(assigned: DataFrame, ids: DataFrame) -> DataFrame:
        """``assigned`` without the records of the given ``id``; unknown ones do no harm."""
        return assigned.join(ids.select("id").distinct(), "id", "left_anti").select(*assigned.columns)

    def rebuilt(self, assigned: DataFrame, lists: int = 256, vector: str = "vector") -> tuple["IvfIndex", DataFrame]:
        """Centroids trained anew on what the lists hold, and the records in their new lists."""
        records = assigned.drop("cid")
        index = IvfIndex.train(records, self.metric, lists, vector=vector)
        return index, index.assign(records, vector)

    def save(self, assigned: DataFrame, path: str) -> None:
        """Records by list, and centroids beside them."""
        assigned.write.mode("overwrite").partitionBy("cid").parquet(f"{path}/records")
        rows = [(i, c.tolist(), self.metric.value) for i, c in enumerate(self.centroids)]
        assigned.sparkSession.createDataFrame(rows, "cid INT, centroid ARRAY<DOUBLE>, metric STRING").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark, path: str) -> tuple["IvfIndex", DataFrame]:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        return cls(np.array([r["centroid"] for r in rows]), Metric.of(rows[0]["metric"] if rows else "cosine")), spark.read.parquet(f"{path}/records")
