"""Fusion of dense and sparse rankings, and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.errors import InvalidQuery
from brindle.functions.filters import compile_filter
from brindle.functions.text import query_weights
from brindle.operators.bm25 import Bm25Index
from brindle.operators.knn import dense_search, top
from brindle.runtime import cut
from brindle.types import Fusion, Metric

def _beside(scores: DataFrame, one: DataFrame) -> DataFrame:
    """``scores`` with the columns of a single row."""
    key = F.lit(1).alias("_one")
    return scores.select("*", key).join(F.broadcast(one.select("*", key)), "_one").drop("_one")


def minmax(scores: DataFrame, column: str = "score") -> DataFrame:
    """``column`` stretched to [0, 1]; 1 if all are equal (within 1e-9). The range is aggregated first, one row."""
    lo, hi = F.col("_lo"), F.col("_hi")
    known = _beside(scores, scores.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))
    return known.withColumn(column, F.when(hi - lo < 1e-9, 1.0).otherwise((F.col(column) - lo) / (hi - lo))).drop("_lo", "_hi")


def softmax(scores: DataFrame, column: str = "score") -> DataFrame:
    """``column`` as exponentials that sum to 1; equal parts if their sum is 0. Aggregated first, one row each."""
    known = _beside(scores, scores.agg(F.max(column).alias("_hi"))).withColumn("_e", F.exp(F.col(column) - F.col("_hi")))
    known = _beside(known, known.agg(F.sum("_e").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    return known.withColumn(column, F.when(F.col("_sum") == 0, 1 / F.col("_n")).otherwise(F.col("_e") / F.col("_sum"))).drop("_hi", "_e", "_sum", "_n")


def weighted_sum(dense: DataFrame, sparse: DataFrame, alpha: float) -> DataFrame:
    """``id, score``: ``alpha`` times the normalised dense score and the rest of the sparse one; a missing side is 0."""
    a = min(max(alpha, 0.0), 1.0)
    d, s = minmax(dense).select("id", F.col("score").alias("d")), minmax(sparse).select("id", F.col("score").alias("s"))
    both = d.join(s, "id", "full_outer")
    return both.select("id", (a * F.coalesce("d", F.lit(0.0)) + (1 - a) * F.coalesce("s", F.lit(0.0))).alias("score"))


def reciprocal_rank(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """``id, score``: the sum of ``1 / (k + place)``; places count from 1 by score (ties: smaller id). The lists are results
    of top-k searches: a place needs them ordered as a whole."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    parts = [one.select("id", (1 / (k + place)).alias("score")) for one in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.sum("score").alias("score"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = 0.7, strategy: Fusion = Fusion()) -> DataFrame:
    """``id, score, dense_score, sparse_score``, the k best. If one side is empty the other's scores stay as they are; the
    sides' own scores are always given unnormalised."""
    empty_dense, empty_sparse = dense.isEmpty(), sparse.isEmpty()
    d, s = dense.select("id", F.col("score").alias("dense_score")), sparse.select("id", F.col("score").alias("sparse_score"))
    if empty_dense or empty_sparse:
        fused = (sparse if empty_dense else dense).select("id", "score")
    elif strategy.kind == "rrf":
        fused = reciprocal_rank([dense, sparse], strategy.k)
    else:
        fused = weighted_sum(dense, sparse, alpha)
    return top(fused.join(d, "id", "left").join(s, "id", "left").select("id", "score", "dense_score", "sparse_score"), k)


def fuse_groups(results: DataFrame, group: str = "query_id", alpha: float = 0.7, dense: str = "dense_score", sparse: str = "sparse_score") -> DataFrame:
    """``group, k, id, score, rank``: the ``k`` best results of every group by the weighted sum of its two scores, each
    stretched to [0, 1] within the group.

    results: one row a group and id, with ``k`` and ``alpha`` (NULL: the default). A missing score is 0. Ranges are aggregated
    before they are joined back, so a group with very many results is never in one task; ties (nine digits): smaller id.
    """
    sides = (dense, sparse)
    ranges = results.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in sides for n, f in (("lo", F.min), ("hi", F.max))])

    def norm(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.coalesce(F.when(F.col(c).isNotNull(), F.when(hi - lo < 1e-9, 1.0).otherwise((F.col(c) - lo) / (hi - lo))), F.lit(0.0))

    a = F.coalesce("alpha", F.lit(alpha))
    fused = results.join(ranges, group).select(group, "k", "id", (a * norm(dense) + (1 - a) * norm(sparse)).alias("score"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= F.col("k"))


def oversample_k(k: int, factor: int = 5) -> int:
    return max(k * factor, k)


def hybrid_search(
    records: DataFrame,
    vector: Sequence[float] | None = None,
    text: str | None = None,
    k: int = 10,
    alpha: float = 0.7,
    strategy: Fusion = Fusion(),
    metric: Metric | str = Metric.COSINE,
    index: Bm25Index | None = None,
    filter=None,
    oversample: int = 5,
) -> DataFrame:
    """Records with ``score, dense_score, sparse_score``: the dense ``5 k`` best, and if there are none the sparse ones, are
    candidates; with a vector, the text scores only the dense candidates. At least one signal is needed."""
    if vector is None and not text:
        raise InvalidQuery("a vector or a text is needed")
    if not 0 <= alpha <= 1 or oversample < 1:
        raise InvalidQuery(f"alpha {alpha} or oversample {oversample} is out of range")
    n = oversample_k(k, oversample)
    records = records.drop("score", "dense_score", "sparse_score")
    none = records.select("id", F.lit(None).cast("double").alias("score")).limit(0)
    dense = dense_search(records, vector, n, metric, filter).select("id", "score") if vector is not None else none
    sparse = none
    if text:
        index = index or Bm25Index.build(records, terms=query_weights(text))
        if vector is not None:
            # At most n rows, which two joins use: written once, so that nothing stays cached.
            dense = cut(dense)
            sparse = index.search(text, n, dense)
        else:
            kept = None if filter is None else records.where(compile_filter(filter)).select("id")
            sparse = index.search(text, n, kept)
    fused = fuse(dense, sparse, k, alpha, strategy)
    return top(fused.join(records, "id"), k)
