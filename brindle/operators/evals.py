"""Quality and latency measures of search results."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``recall``: over all queries of ``truth``, the mean part of their k true ids that were found. Both: ``query_id, id``."""
    t, f = truth.select("query_id", "id").distinct(), found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    each = t.join(f, ["query_id", "id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("r"))
    return each.agg(F.avg("r").alias("recall"))


def _percentile(column: str, place: Callable[[Column], Column]) -> Column:
    values = F.sort_array(F.collect_list(column))
    return F.when(F.size(values) > 0, F.element_at(values, place(F.size(values) - 1).cast("int") + 1))


def percentile_floor(column: str, p: float) -> Column:
    """Aggregate: the value at place ``floor((n - 1) p / 100)``. For the few thousand latencies of a measurement;
    ``exact_percentile`` is for groups of any size."""
    return _percentile(column, lambda last: F.floor(last * p / 100))


def percentile_round(column: str, p: float) -> Column:
    """Aggregate: the value at place ``round((n - 1) p / 100)``, halves away from zero."""
    return _percentile(column, lambda last: F.round(last * p / 100))


def exact_percentile(values: DataFrame, column: str, p: float, rounding: str = "floor", by: str | None = None, buckets: int = 64) -> DataFrame:
    """``value``, or ``by, value`` for each group: the same of groups of any size, without gathering one anywhere.

    Distinct values are counted and divided at approximate quantiles; running sums over the few buckets tell the one in
    which the place lies, and only its values are counted up. NULLs are left out; a group without value has no row.
    """
    key = by or "_all"
    rows = values.where(F.col(column).isNotNull()).select(*([by] if by else [F.lit(0).alias(key)]), F.col(column).cast("double").alias("_v"))
    counts = rows.groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_m"))
    cuts = rows.groupBy(key).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_n"))
    x = (F.col("_n") - 1) * p / 100
    place = (F.floor(x) if rounding == "floor" else F.floor(x + 0.5)).alias("_place")
    placed = counts.join(cuts.select(key, "_cuts", place), key).withColumn("_b", F.size(F.filter("_cuts", _below(F.col("_v")))))
    sums = placed.groupBy(key, "_b", "_place").agg(F.sum("_m").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(key).orderBy("_b")) - F.col("_s")
    bucket = sums.withColumn("_before", before).where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_s")))
    upto = F.sum("_m").over(Window.partitionBy(key, "_b").orderBy("_v")) + F.col("_before")
    inside = placed.drop("_place").join(bucket.select(key, "_b", "_before", "_place"), [key, "_b"]).withColumn("_upto", upto)
    found = inside.where(F.col("_upto") > F.col("_place")).groupBy(key).agg(F.min("_v").alias("value"))
    return found if by else found.select("value")


def _below(value: Column):
    return lambda cut: cut < value


def recall(found: Sequence, truth: Sequence, k: int) -> float:
    return len(set(found[:k]) & set(truth[:k])) / k if k else 0.0


def timed(run: Callable[[], object], times: int = 10) -> dict[str, float]:
    """Mean, median and 99th percentile of seconds, and runs a second, after a tenth as warm-up."""
    for _ in range(max(1, times // 10)):
        run()
    took = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    took.sort()
    at = lambda p: took[math.floor((len(took) - 1) * p / 100)]
    return {"mean": sum(took) / len(took), "p50": at(50), "p99": at(99), "qps": len(took) / sum(took)}


def filtered_ground_truth(queries: DataFrame, records: DataFrame, filter, k: int, metric) -> DataFrame:
    """Exact k best of the records that satisfy the filter, for each query."""
    from brindle.functions.filters import compile_filter
    from brindle.operators.knn import batch_knn

    return batch_knn(queries, records.where(compile_filter(filter)), k, metric)
