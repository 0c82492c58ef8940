"""Dense nearest neighbours by exact scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.errors import DimensionMismatch, InvalidQuery
from brindle.functions.filters import compile_filter
from brindle.types import Metric


def checked(query: Sequence[float], dimension: int | None = None) -> list[float]:
    q = [float(x) for x in query]
    if dimension is not None and len(q) != dimension:
        raise DimensionMismatch(dimension, len(q))
    return q


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best; ties, scores equal to nine digits: smaller id. NaN and NULL scores come last. One heap a partition, then
    one merge."""
    if k < 0:
        raise InvalidQuery(f"k is {k}")
    order = F.when(F.isnan(score), None).otherwise(F.round(score, 9))
    return scored.orderBy(order.desc_nulls_last(), "id").limit(k)


def score_column(query: Sequence[float], metric: Metric | str, vector: str = "vector") -> Column:
    """Score of a vector column against one query, in double; NULL for vectors of another length.

    An Arrow function: only this column goes to Python, batch by batch, and a batch is one matrix product. The expressions
    of ``functions.vector`` give the same, an element at a time.
    """
    q, m = np.array([[float(x) for x in query]]), Metric.of(metric)

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(v), q.shape[1]), False))
        out = np.zeros(len(v))
        if q.shape[1] and fits.any():
            flat = (v if fits.all() else v.filter(pa.array(fits))).flatten()
            out[fits] = _scores(q, np.asarray(flat, np.float64).reshape(-1, q.shape[1]), m)[0]
        return pa.array(out, mask=~fits)

    return score(F.col(vector))


def dense_search(
    records: DataFrame, query: Sequence[float], k: int = 10, metric: Metric | str = Metric.COSINE, filter=None, vector: str = "vector", dimension: int | None = None
) -> DataFrame:
    """``records`` with ``score`` and ``dense_score``, the k best of those that satisfy the filter.

    The filter stands before the top-k, so results are exact whatever its selectivity, and columns that aren't selected
    aren't read. Vectors of other lengths than the query's, and NULL ones, are left out.
    """
    q = checked(query, dimension)
    fitting = records.where(F.size(vector) == len(q))
    if filter is not None:
        fitting = fitting.where(compile_filter(filter))
    scored = fitting.withColumn("score", score_column(q, metric, vector))
    return top(scored, k).withColumn("dense_score", F.col("score"))


def _scores(q: np.ndarray, x: np.ndarray, metric: Metric) -> np.ndarray:
    if metric is Metric.DOT:
        return q @ x.T
    if metric is Metric.EUCLIDEAN:
        d = (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T) + (x * x).sum(axis=1)
        return 1 / (1 + np.sqrt(np.maximum(d, 0)))
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    return np.divide(q @ x.T, n, out=np.zeros((len(q), len(x))), where=n != 0)


def _best(q: np.ndarray, qid: np.ndarray, qgroup, x: np.ndarray, ids: np.ndarray, xgroup, k: int, metric: Metric) -> pa.RecordBatch:
    """The k best of a block of records for each query of a block."""
    by_id = np.argsort(ids, kind="stable")
    s = _scores(q, x, metric)[:, by_id]
    if qgroup is not None:
        s[qgroup[:, None] != xgroup[by_id]] = -np.inf
    order = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
    i = np.repeat(np.arange(len(q)), order.shape[1])
    score = s[i, order.ravel()]
    ok = np.isfinite(score)
    return pa.RecordBatch.from_arrays([pa.array(qid[i[ok]].tolist(), pa.string()), pa.array(ids[by_id[order.ravel()[ok]]].tolist(), pa.string()), pa.array(score[ok])], names=["query_id", "id", "score"])


def batch_knn(
    queries: DataFrame,
    records: DataFrame,
    k: int = 10,
    metric: Metric | str = Metric.COSINE,
    vector: str = "vector",
    group: str | None = None,
    sent_queries: int = 20_000,
    block_rows: int = 2000,
) -> DataFrame:
    """``query_id, id, score, rank`` for a set of queries (``query_id, vector``) against all records.

    Up to ``sent_queries`` queries go out with the tasks that read the records, and nothing but each task's k best a query
    is shuffled. More queries are divided into blocks of about ``block_rows``, the records into larger ones, and every two
    blocks meet in a task of their own; nothing is gathered on the driver then. Scores are matrix products in double. With
    ``group``, a column of both, only records of the query's group count. Ties (nine digits): smaller id. NULL vectors, and
    vectors of another length than the first query's, are left out.
    """
    m, schema = Metric.of(metric), "query_id STRING, id STRING, score DOUBLE"
    grouped = [F.col(group).cast("string").alias("g")] if group else [F.lit(None).cast("string").alias("g")]
    asked = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"), *grouped)
    first = asked.select(F.size("v").alias("n")).first()
    dim = first["n"] if first else 0
    asked = asked.where(F.size("v") == dim)
    fitting = records.where(F.size(vector) == dim).select(F.col("id").cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"), *grouped)

    def parts(t) -> tuple:
        x = np.asarray(pa.chunked_array([t.column("v")]).combine_chunks().flatten() if isinstance(t, pa.RecordBatch) else t["v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        return x, np.array(t.column("id").to_pylist(), object), np.array(t.column("g").to_pylist(), object) if group else None

    count = asked.count()
    if count <= sent_queries:
        sent = [parts(t) for t in (asked.toArrow().slice(i, block_rows) for i in range(0, count, block_rows))]

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, ids, g = parts(b)
                    yield from (_best(q, qid, qg, x, ids, g, k, m) for q, qid, qg in sent)

        found = fitting.mapInArrow(best, schema)
    else:
        nq, nx = -(-count // block_rows), max(1, -(-fitting.count() // (10 * block_rows)))

        def placed(df: DataFrame, n: int, own: str, others: int, other: str, ask: bool) -> DataFrame:
            mine = F.pmod(F.xxhash64("id"), F.lit(n)).alias(own)
            return df.select("id", "v", "g", F.lit(ask).alias("ask"), mine, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))).alias(other))

        def meet(t: pa.Table) -> pa.Table:
            (q, qid, qg), (x, ids, g) = parts(t.filter(t["ask"])), parts(t.filter(pa.array(~np.asarray(t["ask"]))))
            return pa.Table.from_batches([_best(q, qid, qg, x, ids, g, k, m)] if len(q) and len(x) else [], schema=pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())]))

        met = placed(asked, nq, "b", nx, "c", True).unionByName(placed(fitting, nx, "c", nq, "b", False).select("id", "v", "g", "ask", "b", "c"))
        found = met.groupBy("b", "c").applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def post_filter(records: DataFrame, query: Sequence[float], k: int, fetch: int, filter, metric: Metric | str = Metric.COSINE) -> DataFrame:
    """Search, then discard: the baseline that filtering first is compared with. May give fewer than k rows."""
    return top(dense_search(records, query, fetch, metric).where(compile_filter(filter)), k)
