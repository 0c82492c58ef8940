"""One ranking from several differently scaled scores: percentiles, then leximin order.

An item's scores become percentiles among the group's items; its own percentiles are sorted ascending, and items are
ordered by comparing these arrays from the left, so that a weak score can't be masked by strong ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """One row for each key: that of the largest ``at`` (NULL: older than any), of equal ones that of the largest content
    hash. Rows with a NULL key are left out."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    last = rows.where(known).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(at, F.xxhash64(*columns))).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def percentile_ranks(items: DataFrame, group: str, item: str, scores: list[str], large: int = 200_000) -> DataFrame:
    """``items`` with each score replaced by the part of the group's other items that are worse, from 0 to 1.

    NULL and NaN are worse than any value; equal values have equal ranks; the only item of a group has 0. Groups of at
    most ``large`` items are ranked by a window. Larger ones are never sorted in one task: their distinct values are
    counted, divided at approximate quantiles, counted up within each part, and the counts joined back.
    """
    clean = items.select(group, item, *[F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in scores])
    sizes = clean.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sized = clean.join(sizes, group)
    rank = {c: F.percent_rank().over(Window.partitionBy(group).orderBy(F.asc_nulls_first(c))) for c in scores}
    small = sized.where(F.col("_n") <= large).select(group, item, *[r.alias(c) for c, r in rank.items()])
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= large:
        return small
    buckets = int(min(4096, max(64, most // 50_000)))
    out = sized.where(F.col("_n") > large)
    for c in scores:
        v = f"_{c}"
        counts = out.groupBy(group, c, "_n").agg(F.count(F.lit(1)).alias("_m"))
        # Sorting by value within a bucket keeps a window small; NULLs are one value, and lie in bucket -1.
        cuts = out.groupBy(group).agg(F.percentile_approx(c, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
        counts = counts.join(cuts, group).withColumn("_b", F.when(F.col(c).isNull(), -1).otherwise(F.size(F.filter("_cuts", _below(F.col(c))))))
        per = counts.groupBy(group, "_b").agg(F.sum("_m").alias("_m"))
        before = per.select(group, "_b", (F.sum("_m").over(Window.partitionBy(group).orderBy("_b")) - F.col("_m")).alias("_before"))
        w = Window.partitionBy(group, "_b").orderBy(F.asc_nulls_first(c))
        inside = counts.withColumn("_w", F.sum("_m").over(w) - F.col("_m")).join(before, [group, "_b"])
        ranked = inside.select(F.col(group).alias("_g"), F.col(c).alias("_v"), ((F.col("_before") + F.col("_w")) / (F.col("_n") - 1)).alias(v))
        out = out.join(ranked, (F.col(group) == F.col("_g")) & F.col(c).eqNullSafe(F.col("_v")), "left").drop("_g", "_v")
    return small.unionByName(out.select(group, item, *[F.col(f"_{c}").alias(c) for c in scores]))


def _below(value):
    return lambda cut: cut < value


def leximin(items: DataFrame, group: str, item: str, scores: list[str], large: int = 200_000) -> DataFrame:
    """``group, item, levels``: of every item its percentiles in the group, ascending; comparing these arrays orders the
    items, the largest first.

    items: one row a group and item; rows in which one of the two is NULL are left out, other columns ignored; an empty
    table gives no rows.
    """
    known = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item, *scores)
    ranks = percentile_ranks(known, group, item, scores, large)
    return ranks.select(group, item, F.sort_array(F.array(*scores)).alias("levels"))


def first_places(levels: DataFrame, wanted: DataFrame, group: str, item: str, k: str = "k") -> DataFrame:
    """``group, item, place, levels`` of each group's first ``k`` items (equal arrays: smaller item).

    wanted: ``group, k``, one row a group; groups without row, or with NULL or negative ``k``, have none.

    The window keeps its ``k`` best by partition before the shuffle, so that a group of any size sends few rows.
    """
    most = wanted.agg(F.max(k)).first()[0] or 0
    order = Window.partitionBy(group).orderBy(F.desc("levels"), F.col(item).asc())
    top = levels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= int(most))
    return top.join(wanted.select(group, k), group).where(F.col("place") <= F.col(k)).select(group, item, "place", "levels")
