"""Enums, configurations and schemas shared by the operators."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from brindle.errors import InvalidQuery

RECORD_SCHEMA = "id STRING, vector ARRAY<FLOAT>, payload STRING, text STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
RESULT_COLUMNS = ["id", "score", "dense_score", "sparse_score", "payload", "text"]


class Metric(str, Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot"

    @classmethod
    def of(cls, name: "str | Metric") -> "Metric":
        if isinstance(name, cls):
            return name
        known = {"cosine": cls.COSINE, "euclidean": cls.EUCLIDEAN, "dot": cls.DOT, "dot_product": cls.DOT}
        if str(name).lower() not in known:
            raise InvalidQuery(f"unknown metric {name!r}")
        return known[str(name).lower()]


class IndexType(str, Enum):
    HNSW = "HNSW"  # accepted, and answered by the exact scan, which finds all that a graph could
    IVF = "IVF"


class Quantization(str, Enum):
    NONE = "None"
    SCALAR_INT8 = "ScalarInt8"
    BINARY = "Binary"


@dataclass(frozen=True)
class Fusion:
    """``weighted`` sum of normalised scores, or ``rrf`` with constant k."""

    kind: str = "weighted"
    k: int = 60

    def __post_init__(self):
        if self.kind not in ("weighted", "rrf"):
            raise InvalidQuery(f"unknown fusion strategy {self.kind!r}")


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    metric: Metric = Metric.COSINE
    index_type: IndexType = IndexType.HNSW
    hnsw_m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    quantization: Quantization = Quantization.NONE
    indexed_fields: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", self.name):
            raise InvalidQuery(f"bad collection name {self.name!r}")
        if not 1 <= self.dimension <= 65536:
            raise InvalidQuery(f"bad dimension {self.dimension}")

    def with_quantization(self, q: Quantization) -> "CollectionConfig":
        return replace(self, quantization=q)

    def with_indexed_fields(self, fields) -> "CollectionConfig":
        return replace(self, indexed_fields=tuple(fields))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "CollectionConfig":
        d = json.loads(text)
        return cls(**(d | {"metric": Metric.of(d.get("metric", "cosine")), "index_type": IndexType(d.get("index_type", "HNSW")), "quantization": Quantization(d.get("quantization", "None")), "indexed_fields": tuple(d.get("indexed_fields", ()))}))


@dataclass(frozen=True)
class SearchRequest:
    collection: str = ""
    vector: tuple[float, ...] | None = None
    query_text: str | None = None
    k: int = 10
    alpha: float = 0.7
    filter: object = None
    columns: tuple[str, ...] = ()
