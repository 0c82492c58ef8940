"""Queries of the training-data operators; each works on its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import aq_knn, density_peaks as dp, fm_spans as fm, leakage, leximin as lex, mixing, near_duplicates as nd, parsimonious as plm
from brindle.llm.live import live_records
from brindle.runtime import cut, table


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return dp.density_peaks(live_records(table(spark, d, "vectors"), ["vector"]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dp.same_cluster(table(spark, d, "pair_probe"), _clusters(spark, d))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dp.describe_clusters(cut(_clusters(spark, d)))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """Every record's cluster, NULL for none."""
    return _clusters(spark, d).select("id", "cluster_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    live = live_records(table(spark, d, "vectors"), ["vector", "collection_name"])
    return aq_knn.similar_pairs(aq_knn.nearest(live, k=5, min_similarity=0.9), 0.9)


def _knn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The 5 most similar records of the collection for every live record whose mmap_index is divisible by 20, against all;
    all records, and the records asked for."""
    live = cut(live_records(table(spark, d, "vectors"), ["vector", "collection_name", "mmap_index"]))
    asked = live.where("mmap_index % 20 = 0")
    return aq_knn.nearest(live, k=5, queries=asked), live, asked


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d)[0].select("id", F.col("rank").cast("bigint").alias("rank"), "neighbour", F.round("similarity", 6).alias("similarity"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether p2_knn holds at least nine tenths of the neighbours that brute force finds for the same records."""
    found, live, asked = _knn(spark, d)
    r = aq_knn.recall(found, live, asked, 5)
    return r.select("asked", "expected", (F.col("hit") >= 0.9 * F.col("expected")).alias("reached"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    # Vectors only matter where there is no text; dropping the others before the shuffle halves it.
    rows = table(spark, d, "vectors").withColumn("vector", F.when(nd.no_text("text"), F.col("vector")))
    return nd.near_duplicate_groups(live_records(rows, ["text", "vector"]), width=3, text_similarity=0.6, vector_similarity=0.98)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nd.group_pairs(cut(_groups(spark, d)))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    live = live_records(table(spark, d, "vectors"), ["collection_name"])
    live = cut(live)
    postings, lengths = table(spark, d, "postings"), table(spark, d, "doc_lengths")
    # The postings of a record lie together, so its repetitions vanish before the shuffle.
    with_any = postings.where("raw_count > 0 OR raw_count IS NULL AND term_frequency > 0").select("collection_name", "id").distinct()
    records = with_any.join(live, ["collection_name", "id"], "left_semi")
    return plm.characteristic_terms(plm.distinct_postings(postings, live, lengths), records)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return plm.outstanding_terms(_terms(spark, d))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every live record with its probability and place."""
    return _terms(spark, d).select("collection_name", "id", "place", "term", "probability")


def _places(spark: SparkSession, d: str) -> DataFrame:
    scores = ["dense_score", "sparse_score", "score"]
    results = lex.latest(table(spark, d, "search_results"), ["query_id", "id"], "returned_at", scores)
    wanted = table(spark, d, "queries").groupBy("query_id").agg(F.max("k").alias("k"))
    return lex.first_places(lex.leximin(results, "query_id", "id", scores), wanted, "query_id", "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("query_id", "id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("query_id", F.col("place").cast("bigint").alias("place"), "id", F.round(F.col("levels")[0], 6).alias("weakest"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).withColumn("share", F.round("share", 6))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(mixing.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mixture(_sized(spark, d), table(spark, d, "mix_targets")).where("NOT reachable").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document stands in the mixture."""
    sized = _sized(spark, d)
    return mixing.repetitions(sized, mixing.plan_mixture(sized, table(spark, d, "mix_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    plan = mixing.plan_mixture(sized, table(spark, d, "mix_targets"))
    return mixing.mixture_shares(mixing.repetitions(sized, plan), plan)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, _, copies = fm.shared_spans(table(spark, d, "documents"))
    return fm.shared_pairs(pairs, copies)


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document recurs in others."""
    docs = table(spark, d, "documents")
    _, spans, copies = fm.shared_spans(docs, with_pairs=False)
    return fm.shared_parts(docs, spans, copies)


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each document that recur in others."""
    docs = table(spark, d, "documents")
    _, spans, copies = fm.shared_spans(docs, with_pairs=False)
    return fm.shared_stretches(docs, spans, copies)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from brindle.llm import oracle

    return oracle.oracle_sql()
