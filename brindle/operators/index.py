"""Dense indexes with one life cycle: build, insert, search, delete, rebuild, save, load.

An index is immutable; what changes it returns another. Deletions and insertions are joins over the rows, never loops.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.errors import DimensionMismatch, NotFound
from brindle.operators.ivf import IvfIndex
from brindle.operators.knn import checked, dense_search
from brindle.operators.quantize import UNTRAINED, Binary, Int8
from brindle.types import CollectionConfig, IndexType, Metric, Quantization


class DenseIndex(Protocol):
    rows: DataFrame

    def insert(self, records: DataFrame) -> "DenseIndex": ...
    def delete(self, id: str) -> "DenseIndex": ...
    def search(self, query: Sequence[float], k: int = 10) -> DataFrame: ...
    def rebuild(self) -> "DenseIndex": ...
    def save(self, path: str) -> None: ...


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` but those whose id is among ``ids``; NULL ids stay."""
    return rows.join(ids.select("id").distinct(), "id", "left_anti").select(*rows.columns)


@dataclass(frozen=True)
class _Base:
    rows: DataFrame
    config: CollectionConfig

    kind = "exact"

    @classmethod
    def build(cls, records: DataFrame, config: CollectionConfig) -> "_Base":
        wrong = records.where(F.col("vector").isNotNull() & (F.size("vector") != config.dimension)).select(F.size("vector").alias("n")).first()
        if wrong:
            raise DimensionMismatch(config.dimension, wrong["n"])
        return cls(records.where("vector IS NOT NULL"), config)

    @property
    def metric(self) -> Metric:
        return self.config.metric

    def __len__(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def insert(self, records: DataFrame):
        """Records of known ids are replaced."""
        return replace(self, rows=without(self.rows, records).unionByName(self._prepared(records), allowMissingColumns=True))

    def _prepared(self, records: DataFrame) -> DataFrame:
        return records

    def delete(self, id: str):
        if self.rows.where(F.col("id") == id).isEmpty():
            raise NotFound(id)
        return replace(self, rows=self.rows.where(F.col("id") != id))

    def rebuild(self):
        """Trained anew on what the index holds."""
        return type(self).build(self.rows.drop("codes", "norm2", "words", "cid"), self.config)

    def search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        return dense_search(self.rows, checked(query, self.config.dimension), k, self.metric)

    def _state(self):
        return None

    def _by(self) -> list[str]:
        return []

    def save(self, path: str) -> None:
        """Rows, and what was trained beside them."""
        self.rows.write.mode("overwrite").partitionBy(*self._by()).parquet(f"{path}/rows")
        meta = json.dumps({"kind": self.kind, "config": self.config.to_json(), "state": self._state()})
        self.rows.sparkSession.createDataFrame([(meta,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


class ExactIndex(_Base):
    """Scans all vectors; stands for the graph index, whose answers it contains."""


@dataclass(frozen=True)
class Int8Index(_Base):
    """One byte a dimension. Fewer than 256 vectors are compared as they are; later ones are encoded with the ranges that
    were fitted."""

    fitted: Int8 | None = None
    kind = "int8"

    @classmethod
    def build(cls, records: DataFrame, config: CollectionConfig) -> "Int8Index":
        base = _Base.build(records, config)
        if len(base) < UNTRAINED:
            return cls(base.rows, config)
        fitted = Int8.fit(base.rows, config.metric)
        return cls(fitted.build(base.rows), config, fitted)

    def _prepared(self, records: DataFrame) -> DataFrame:
        return self.fitted.build(records) if self.fitted else records

    def search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        q = checked(query, self.config.dimension)
        return self.fitted.search(self.rows, q, k) if self.fitted else dense_search(self.rows, q, k, self.metric)

    def code_bytes(self) -> int:
        return Int8.code_bytes(len(self), self.config.dimension)

    def _state(self):
        return [self.fitted.dmin, self.fitted.dscale] if self.fitted else None

    @classmethod
    def restored(cls, rows: DataFrame, config: CollectionConfig, state) -> "Int8Index":
        return cls(rows, config, Int8(tuple(state[0]), tuple(state[1]), config.metric) if state else None)


@dataclass(frozen=True)
class BinaryIndex(_Base):
    """One bit a dimension."""

    fitted: Binary | None = None
    kind = "binary"

    @classmethod
    def build(cls, records: DataFrame, config: CollectionConfig) -> "BinaryIndex":
        base = _Base.build(records, config)
        if len(base) < UNTRAINED:
            return cls(base.rows, config)
        fitted = Binary.fit(base.rows)
        return cls(fitted.build(base.rows), config, fitted)

    def _prepared(self, records: DataFrame) -> DataFrame:
        return self.fitted.build(records) if self.fitted else records

    def search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        q = checked(query, self.config.dimension)
        return self.fitted.search(self.rows, q, k) if self.fitted else dense_search(self.rows, q, k, self.metric)

    def rerank(self, query: Sequence[float], k: int = 10, candidates: int = 100, metric: Metric | str = Metric.EUCLIDEAN) -> DataFrame:
        """Candidates by bits, ranked by their vectors."""
        q = checked(query, self.config.dimension)
        return self.fitted.rerank(self.rows, q, k, candidates, metric) if self.fitted else dense_search(self.rows, q, k, metric)

    def _state(self):
        return self.fitted.thresholds if self.fitted else None

    @classmethod
    def restored(cls, rows: DataFrame, config: CollectionConfig, state) -> "BinaryIndex":
        return cls(rows, config, Binary(tuple(state)) if state else None)


@dataclass(frozen=True)
class ListIndex(_Base):
    """IVF lists; saved by list, so that a loaded index reads only the lists that a query probes."""

    lists: IvfIndex | None = None
    kind = "ivf"

    @classmethod
    def build(cls, records: DataFrame, config: CollectionConfig) -> "ListIndex":
        base = _Base.build(records, config)
        ivf = IvfIndex.train(base.rows, config.metric)
        return cls(ivf.assign(base.rows), config, ivf) if len(ivf.centroids) else cls(base.rows, config)

    def _prepared(self, records: DataFrame) -> DataFrame:
        return self.lists.assign(records) if self.lists else records

    def delete(self, id: str) -> "ListIndex":
        """Unknown ids do no harm."""
        return replace(self, rows=self.rows.where(F.col("id") != id))

    def search(self, query: Sequence[float], k: int = 10, probes: int = 16) -> DataFrame:
        q = checked(query, self.config.dimension)
        return self.lists.search(self.rows, q, k, probes) if self.lists else dense_search(self.rows, q, k, self.metric)

    def _state(self):
        return self.lists.centroids.tolist() if self.lists else None

    def _by(self) -> list[str]:
        return ["cid"] if self.lists else []

    @classmethod
    def restored(cls, rows: DataFrame, config: CollectionConfig, state) -> "ListIndex":
        return cls(rows, config, IvfIndex(np.array(state), config.metric) if state else None)


def index_class(config: CollectionConfig) -> type[_Base]:
    """Quantisation decides before the index type."""
    if config.quantization is Quantization.SCALAR_INT8:
        return Int8Index
    if config.quantization is Quantization.BINARY:
        return BinaryIndex
    return ListIndex if config.index_type is IndexType.IVF else ExactIndex


def build_index(records: DataFrame, config: CollectionConfig) -> _Base:
    return index_class(config).build(records, config)


def load_index(spark: SparkSession, path: str) -> _Base:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    config, rows = CollectionConfig.from_json(meta["config"]), spark.read.parquet(f"{path}/rows")
    kinds = {c.kind: c for c in (Int8Index, BinaryIndex, ListIndex)}
    return kinds[meta["kind"]].restored(rows, config, meta["state"]) if meta["kind"] in kinds else ExactIndex(rows, config)
