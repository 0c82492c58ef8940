"""Scans of quantised vectors: one byte or one bit a dimension."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions import vector as V
from brindle.operators.knn import dense_search, top
from brindle.types import Metric

UNTRAINED = 256  # fewer vectors than this are compared as they are


def _by_dimension(records: DataFrame, vector: str) -> DataFrame:
    """``i, x``: every element of every vector."""
    return records.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))


def int8_params(records: DataFrame, vector: str = "vector") -> DataFrame:
    """``i, dmin, dscale`` of each dimension: least value, and a 255th of the range (1 if there is none)."""
    p = _by_dimension(records, vector).groupBy("i").agg(F.min("x").alias("dmin"), F.max("x").alias("dmax"))
    finite = F.abs("dmin") < float("inf")
    return p.select("i", F.when(finite, F.col("dmin")).otherwise(0.0).alias("dmin"), F.when(F.col("dmax") > F.col("dmin"), (F.col("dmax") - F.col("dmin")) / 255).otherwise(1.0).alias("dscale"))


@dataclass(frozen=True)
class Int8:
    """Fitted ranges; they are as many as a vector has dimensions."""

    dmin: tuple[float, ...]
    dscale: tuple[float, ...]
    metric: Metric = Metric.COSINE

    @classmethod
    def fit(cls, records: DataFrame, metric: Metric | str = Metric.COSINE, vector: str = "vector") -> "Int8":
        m = Metric.of(metric)
        if m is Metric.COSINE:
            records = records.select(V.normalize(vector).alias(vector))
        rows = int8_params(records, vector).orderBy("i").collect()
        return cls(tuple(r["dmin"] for r in rows), tuple(r["dscale"] for r in rows), m)

    def _lits(self, xs: Sequence[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in xs])

    def encode(self, vector: Column | str) -> Column:
        """Codes from -128 to 127; halves are rounded away from zero."""
        steps = F.zip_with(F.zip_with(V.as_double(vector), self._lits(self.dmin), lambda x, m: x - m), self._lits(self.dscale), lambda x, s: x / s)
        return F.transform(steps, lambda u: (F.least(F.greatest(F.round(u), F.lit(0.0)), F.lit(255.0)) - 128).cast("tinyint"))

    def decode(self, codes: Column | str) -> Column:
        scaled = F.zip_with(V.as_double(codes), self._lits(self.dscale), lambda c, s: (c + 128) * s)
        return F.zip_with(scaled, self._lits(self.dmin), lambda x, m: x + m)

    def build(self, records: DataFrame, vector: str = "vector") -> DataFrame:
        """``records`` with ``codes`` and the squared length ``norm2`` of what they stand for."""
        source = V.normalize(vector) if self.metric is Metric.COSINE else V.as_double(vector)
        coded = records.withColumn("codes", self.encode(source))
        return coded.withColumn("norm2", V.dot(self.decode("codes"), self.decode("codes")))

    def search(self, built: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
        """Scan of the codes: ``<q, x> = <q, offset> + sum(q * scale * code)``; what depends on the query alone is computed
        once, here."""
        q = [float(x) for x in query]
        if self.metric is Metric.COSINE and (length := sum(x * x for x in q) ** 0.5) >= 1e-10:
            q = [x / length for x in q]
        constant = sum(x * (m + 128 * s) for x, m, s in zip(q, self.dmin, self.dscale))
        inner = F.lit(constant) + V.dot("codes", [x * s for x, s in zip(q, self.dscale)])
        q2 = sum(x * x for x in q)
        if self.metric is Metric.EUCLIDEAN:
            score = 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), q2 - 2 * inner + F.col("norm2"))))
        elif self.metric is Metric.COSINE:
            n = F.sqrt(F.col("norm2")) * q2**0.5
            score = F.when(n == 0, 0.0).otherwise(inner / n)
        else:
            score = inner
        return top(built.withColumn("score", score), k)

    @staticmethod
    def code_bytes(rows: int, dimension: int) -> int:
        """Bytes of codes, lengths and ranges."""
        return rows * dimension + rows * 4 + dimension * 8


def int8_search(records: DataFrame, query: Sequence[float], k: int = 10, metric: Metric | str = Metric.COSINE, vector: str = "vector") -> DataFrame:
    """Fit, encode and search; fewer than 256 vectors are compared at full precision."""
    if records.count() < UNTRAINED:
        return dense_search(records, query, k, metric, vector=vector)
    fitted = Int8.fit(records, metric, vector)
    return fitted.search(fitted.build(records, vector), query, k)


@dataclass(frozen=True)
class Binary:
    """Means of the dimensions; a bit is set where a vector is above."""

    thresholds: tuple[float, ...]

    @classmethod
    def fit(cls, records: DataFrame, vector: str = "vector") -> "Binary":
        rows = _by_dimension(records, vector).groupBy("i").agg(F.avg("x").alias("mean")).orderBy("i").collect()
        return cls(tuple(r["mean"] for r in rows))

    def bits(self, vector: Column | str) -> Column:
        return F.zip_with(V.as_double(vector), F.array(*[F.lit(t) for t in self.thresholds]), lambda x, t: (x > t).cast("long"))

    def encode(self, vector: Column | str) -> Column:
        """Words of 64 bits, the first dimension in the lowest."""
        b = self.bits(vector)

        def word(w: int) -> Column:
            part = F.slice(b, 64 * w + 1, 64)
            moved = F.transform(part, lambda x, i: F.call_function("shiftleft", x, i))
            return F.aggregate(moved, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

        return F.array(*[word(w) for w in range(-(-len(self.thresholds) // 64))])

    def encode_literal(self, query: Sequence[float]) -> list[int]:
        words = []
        for w in range(0, len(self.thresholds), 64):
            value = sum(1 << i for i, (x, t) in enumerate(zip(query[w : w + 64], self.thresholds[w : w + 64])) if x > t)
            words.append(value - (1 << 64) if value >= 1 << 63 else value)
        return words

    def build(self, records: DataFrame, vector: str = "vector") -> DataFrame:
        return records.withColumn("words", self.encode(vector))

    def similarity(self, words: Column | str, query: Sequence[float]) -> Column:
        """One minus the part of the bits that differ."""
        words = F.col(words) if isinstance(words, str) else words
        q = F.array(*[F.lit(w).cast("long") for w in self.encode_literal(query)])
        differing = F.aggregate(F.zip_with(words, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        return 1 - differing / len(self.thresholds)

    def search(self, built: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
        return top(built.withColumn("score", self.similarity("words", query)), k)

    def rerank(self, built: DataFrame, query: Sequence[float], k: int = 10, candidates: int = 100, metric: Metric | str = Metric.EUCLIDEAN, vector: str = "vector") -> DataFrame:
        """The candidates of most equal bits, ranked by their vectors."""
        return dense_search(self.search(built, query, candidates).drop("score"), query, k, metric, vector=vector)


def binary_search(records: DataFrame, query: Sequence[float], k: int = 10, metric: Metric | str = Metric.COSINE, vector: str = "vector") -> DataFrame:
    if records.count() < UNTRAINED:
        return dense_search(records, query, k, metric, vector=vector)
    fitted = Binary.fit(records, vector)
    return fitted.search(fitted.build(records, vector), query, k)
