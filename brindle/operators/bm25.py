"""BM25 full-text search over posting tables."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from brindle.errors import NotFound
from brindle.functions.text import once, query_weights, term_frequencies, tokens
from brindle.operators.knn import top


def idf(n, df):
    """``ln((n - df + 0.5) / (df + 0.5) + 1)`` of columns."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def doc_stats(records: DataFrame, text: str = "text") -> DataFrame:
    """``n, avgdl, total``: documents with at least one token, their mean length, and all tokens; one row."""
    lengths = once(records.select(text), F.size(tokens(text)), "dl").where("dl > 0")
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))


@dataclass
class Bm25Index:
    """Postings ``id, term, tf, dl``: the document's length stands in each of its postings, so scoring joins nothing."""

    postings: DataFrame
    k1: float = 1.5
    b: float = 0.75
    lengths: DataFrame | None = None  # dl of every document; without it, lengths are taken from the postings
    known: tuple[int, float] | None = None

    @classmethod
    def build(cls, records: DataFrame, id_col: str = "id", text: str = "text", k1: float = 1.5, b: float = 0.75, terms: Iterable[str] | None = None, **options) -> "Bm25Index":
        """Documents without token aren't counted. One shuffle, by document and term; lengths are counted before it. With
        ``terms`` only their postings are kept, enough for a query of these terms: statistics are still those of all."""
        words = once(records.select(F.col(id_col).alias("id"), F.col(text).alias("text")), tokens("text", **options), "tk").where(F.size("tk") > 0)
        lengths = words.select(F.size("tk").cast("bigint").alias("dl"))
        if terms is not None:
            words = words.withColumn("asked", F.filter("tk", lambda t: t.isin(list(terms))))
        rows = words.select("id", F.size("tk").cast("bigint").alias("dl"), F.explode("tk" if terms is None else "asked").alias("term"))
        return cls(rows.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), k1, b, lengths)

    def documents(self) -> DataFrame:
        return self.postings.select("id", "dl").distinct()

    def idf(self) -> DataFrame:
        """``term, df, idf``."""
        n = self.stats()[0]
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return df.withColumn("idf", idf(F.lit(n), F.col("df")))

    def stats(self) -> tuple[int, float]:
        """Number of documents and their mean length, from one aggregate, the first time that they are needed."""
        if self.known is None:
            lengths = self.documents() if self.lengths is None else self.lengths
            row = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
            self.known = row["n"], row["avgdl"] or 0.0
        return self.known

    def score(self, terms: dict[str, int], candidates: DataFrame | None = None) -> DataFrame:
        """``id, score`` of documents with at least one of the terms; a term asked for twice counts twice.

        Only the postings of these terms are read. Statistics are those of all documents, also if only ``candidates``
        (``id``) are scored.
        """
        n, avgdl = self.stats()
        mine = self.postings.where(F.col("term").isin(list(terms)))
        dfs = {r["term"]: r["df"] for r in mine.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        if not dfs:
            return self.postings.select("id", F.lit(0.0).alias("score")).limit(0)
        if candidates is not None:
            mine = mine.join(candidates.select("id").distinct(), "id", "left_semi")
        weight = F.lit(0.0)
        for t, df in sorted(dfs.items()):
            weight = F.when(F.col("term") == t, terms[t] * math.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(weight)
        tf, longer = F.col("tf"), 1 - self.b + self.b * F.col("dl") / max(avgdl, 1.0)
        return mine.groupBy("id").agg(F.sum(weight * tf * (self.k1 + 1) / (tf + self.k1 * longer)).alias("score"))

    def search(self, text: str, k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        """``id, score``: the k best; ties: smaller id."""
        return top(self.score(query_weights(text), candidates), k)

    def upsert(self, records: DataFrame, **options) -> "Bm25Index":
        """Index in which the given documents' postings are replaced."""
        kept = self.postings.join(records.select("id").distinct(), "id", "left_anti")
        return Bm25Index(kept.unionByName(Bm25Index.build(records, **options).postings), self.k1, self.b)

    def remove(self, id: str) -> "Bm25Index":
        if self.postings.where(F.col("id") == id).isEmpty():
            raise NotFound(id)
        return Bm25Index(self.postings.where(F.col("id") != id), self.k1, self.b)

    def doc_count(self) -> int:
        return self.stats()[0]

    def save(self, path: str) -> None:
        """Postings in the order of terms, so that a query skips the row groups of other terms, and the statistics."""
        self.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        n, avgdl = self.stats()
        self.postings.sparkSession.createDataFrame([(n, avgdl)], "n BIGINT, avgdl DOUBLE").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark, path: str, k1: float = 1.5, b: float = 0.75) -> "Bm25Index":
        row = spark.read.parquet(f"{path}/stats").first()
        return cls(spark.read.parquet(f"{path}/postings"), k1, b, known=(row["n"], row["avgdl"]))


def sparse_search(records: DataFrame, text: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``records`` with ``score``, ``sparse_score``: the k best, of those with one of the terms. Without an index: one pass
    for the statistics, one that scores; nothing is shuffled but the k best."""
    weights = query_weights(text)
    tk = once(records, tokens("text"), "_tk").where(F.size("_tk") > 0)
    counts = {t: F.size(F.filter("_tk", _is(t))) for t in weights}
    row = tk.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_tk")).alias("avgdl"), *[F.sum((c > 0).cast("bigint")).alias(f"d{i}") for i, c in enumerate(counts.values())]).first()
    score, any_ = F.lit(0.0), F.lit(False)
    for i, (t, c) in enumerate(counts.items()):
        tf = c.cast("double")
        rarity = idf(F.lit(row["n"]), F.lit(row[f"d{i}"] or 0))
        score = score + weights[t] * rarity * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("_tk") / max(row["avgdl"] or 0.0, 1.0)))
        any_ = any_ | (c > 0)
    return top(tk.where(any_).withColumn("score", score).drop("_tk"), k).withColumn("sparse_score", F.col("score"))


def batch_search(records: DataFrame, queries: DataFrame, group: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, rank, id, score``: for every query (``query_id, query_text, k`` and ``group``) the ``k`` best records
    (``id, text``) of its group, by the group's own statistics.

    Only postings of terms that are asked for are counted and joined. NULL texts and queries find nothing; ties (nine
    digits): smaller id. An empty table on either side gives no rows.
    """
    r = once(records.select(F.col(group).alias("g"), "id", "text"), tokens("text"), "tk").where(F.size("tk") > 0)
    stats = r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tk")).alias("avgdl"))
    q = queries.where("query_text IS NOT NULL").select("query_id", F.col(group).alias("g"), "k", F.explode(tokens("query_text", stopwords=False)).alias("term"))
    terms = q.groupBy("query_id", "g", "k", "term").agg(F.count(F.lit(1)).alias("w"))
    words = r.select("g", "id", F.size("tk").alias("dl"), F.explode("tk").alias("term")).join(terms.select("g", "term").distinct(), ["g", "term"], "left_semi")
    wanted = words.groupBy("g", "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = wanted.groupBy("g", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, ["g", "term"]).join(stats, "g")
    tf = F.col("tf")
    part = F.col("w") * idf(F.col("n"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    scores = wanted.join(weighted, ["g", "term"]).groupBy("query_id", "k", "id").agg(F.sum(part).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k")).select("query_id", "rank", "id", "score")


def _is(term: str):
    return lambda x: x == term


__all__ = ["Bm25Index", "batch_search", "doc_stats", "idf", "sparse_search", "term_frequencies"]
