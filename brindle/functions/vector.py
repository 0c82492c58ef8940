"""Similarity kernels as column expressions, computed in double."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from brindle.types import Metric


def as_double(v: Column | str | Sequence[float]) -> Column:
    """A column, its name, or a literal vector as ARRAY<DOUBLE>."""
    if isinstance(v, str):
        v = F.col(v)
    if not isinstance(v, Column):
        v = F.array(*[F.lit(float(x)) for x in v])
    return v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a) -> Column:
    if not isinstance(a, (str, Column)):
        return F.lit(math.sqrt(sum(float(x) * float(x) for x in a)))  # once, not for every row
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine; 0 if one of the vectors has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_distance(a, b) -> Column:
    return 1 - cosine(a, b)


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def dot_distance(a, b) -> Column:
    return 1 - dot(a, b)


def normalize(a) -> Column:
    """Vector of length one; unchanged if its length is below 1e-10."""
    v, n = as_double(a), norm(a)
    return F.when(n < 1e-10, v).otherwise(F.transform(v, lambda x: x / n))


def distance(a, b, metric: Metric | str) -> Column:
    return {Metric.COSINE: cosine_distance, Metric.EUCLIDEAN: euclidean, Metric.DOT: dot_distance}[Metric.of(metric)](a, b)


def to_score(d: Column, metric: Metric | str) -> Column:
    """Score of a distance, higher is better: 1 / (1 + d) for euclidean, else 1 - d."""
    return 1 / (1 + d) if Metric.of(metric) is Metric.EUCLIDEAN else 1 - d


def similarity(a, b, metric: Metric | str) -> Column:
    return to_score(distance(a, b, metric), metric)


#: The kernels for plain Spark SQL.
SQL_FUNCTIONS = {
    "vec_dot": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_l2": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vector_sim": "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) * sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x))), 0D)",
}


def register_sql_functions(spark) -> None:
    """Makes ``vec_dot``, ``vec_l2`` and ``vector_sim`` of two ARRAY<DOUBLE> known to the session's SQL."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
