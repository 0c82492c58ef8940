"""Queries of the engine's own operators over the driver's tables; ``brindle.oracle`` has their SQL.

The collection searched is the ``vectors`` table's present state: the latest row of every id, without deleted ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from brindle.functions import filters, text as T, vector as V
from brindle.operators import bm25, evals, fusion, index, ivf, knn, quantize
from brindle.plans import planner
from brindle.runtime import ensure_checkpoint_dir, table
from brindle.sources import files, store
from brindle.sources.store import Db, latest
from brindle.streaming import ingest
from brindle.types import CollectionConfig, Fusion, Metric, SearchRequest

#: The text searched for, and the filters, in these queries and their SQL.
QUESTION = "the embedding of a slow query and a broken backup query"
MEDICAL = {"field": "topic", "op": "=", "value": "medical"}
CONFIG = CollectionConfig("vectors", 64)


def state(spark: SparkSession, d: str) -> DataFrame:
    """Latest rows of all ids, live or not."""
    return latest(table(spark, d, "vectors"), "id", "updated_at")


def live(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d).where("deleted = 0").drop("deleted", "mmap_index")


def usable(v: Column) -> Column:
    return F.coalesce((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Live records with a usable vector."""
    return live(spark, d).where(usable(F.col("vector")))


def asked(spark: SparkSession, d: str) -> list[float]:
    """The query vector: that of the record of least id."""
    return list(records(spark, d).orderBy("id").select("vector").first()[0])


def _shown(df: DataFrame, *columns: str, score: str = "score") -> DataFrame:
    return df.select("id", F.round(score, 6).alias("score"), *columns)


# Dense search


def dense_cosine(spark, d):
    return _shown(knn.dense_search(records(spark, d), asked(spark, d), 20, Metric.COSINE))


def dense_euclidean(spark, d):
    return _shown(knn.dense_search(records(spark, d), asked(spark, d), 20, Metric.EUCLIDEAN))


def dense_dot(spark, d):
    return _shown(knn.dense_search(records(spark, d), asked(spark, d), 20, Metric.DOT))


def vector_normalize(spark, d):
    n = V.normalize("vector")
    return live(spark, d).where("size(vector) > 0 AND NOT exists(vector, x -> isnan(x))").select("id", F.round(V.norm(n), 6).alias("length"), F.round(n[0], 6).alias("first"))


def pairwise_similarity(spark, d):
    r = records(spark, d)
    a, b = r.select(F.col("id").alias("id_a"), F.col("vector").alias("a")), r.select(F.col("id").alias("id_b"), F.col("vector").alias("b"))
    p = table(spark, d, "pair_probe").join(a, "id_a").join(b, "id_b")
    return p.select("pair_id", F.round(V.cosine("a", "b"), 6).alias("cosine"), F.round(V.euclidean("a", "b"), 6).alias("euclidean"), F.round(V.dot("a", "b"), 5).alias("dot"))


def pairwise_distance(spark, d):
    """Distances of the probe pairs by each metric, and their scores."""
    r = records(spark, d)
    a, b = r.select(F.col("id").alias("id_a"), F.col("vector").alias("a")), r.select(F.col("id").alias("id_b"), F.col("vector").alias("b"))
    p = table(spark, d, "pair_probe").join(a, "id_a").join(b, "id_b")
    each = {m.value: V.distance("a", "b", m) for m in Metric}
    return p.select("pair_id", *[F.round(x, 5).alias(m) for m, x in each.items()], *[F.round(V.to_score(x, m), 5).alias(f"{m}_score") for m, x in each.items()])


def batch_knn(spark, d):
    """The 5 records nearest to every stored centroid."""
    c = table(spark, d, "ivf_centroids").where(usable(F.col("centroid")))
    q = c.groupBy(F.concat_ws("/", "collection_name", "list_id").alias("query_id")).agg(F.min("centroid").alias("vector"))
    return knn.batch_knn(q, records(spark, d), 5, Metric.COSINE).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def ground_truth_l2(spark, d):
    """The 5 records nearest to every embedding, by euclidean distance."""
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.batch_knn(q, records(spark, d), 5, Metric.EUCLIDEAN).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# Filters


def _filtered(filter):
    def query(spark, d):
        return live(spark, d).where(filters.compile_filter(filter)).select("id")

    return query


FILTERS = {
    "filter_eq": MEDICAL,
    "filter_neq": {"field": "region", "op": "!=", "value": "EU"},
    "filter_range": [{"field": "year", "op": ">=", "value": 2023}, {"field": "year", "op": "<", "value": 2025}],
    "filter_like": {"field": "region", "op": "LIKE", "value": "%A%"},
    "filter_nested": {"field": "meta.lang", "op": "=", "value": "en"},
    "filter_and": {"topic": "medical", "year": 2023},
    "filter_coerce": {"field": "year", "op": "=", "value": 2023.0},
    "filter_id": {"field": "id", "op": "LIKE", "value": "vec%"},
    "filter_null": {"field": "region", "op": "=", "value": None},
    "filter_unknown": {"field": "year", "op": "~", "value": 2023},
    "filter_flag": [{"field": "topic", "op": "!=", "value": True}, {"field": "year", "op": "<=", "value": "2024"}],
}
globals().update({name: _filtered(f) for name, f in FILTERS.items()})


def dense_filtered_selective(spark, d):
    return _shown(knn.dense_search(records(spark, d), asked(spark, d), 20, filter=[MEDICAL, {"field": "year", "op": "=", "value": 2023}]))


def dense_filtered_indexed(spark, d):
    """The same on a collection whose topic and year are indexed: its files are skipped by them."""
    db = Db.open(spark, _folder(spark))
    c = db.create_collection_with(CONFIG.with_indexed_fields(["topic", "year"]))
    c.insert_frame(records(spark, d).select("id", "vector", "payload", "text"))
    c.compact()
    return _shown(c.query_filtered(asked(spark, d), 20, [MEDICAL, {"field": "year", "op": "=", "value": 2023}]))


def dense_filtered_weak(spark, d):
    return _shown(knn.dense_search(records(spark, d), asked(spark, d), 20, filter={"field": "year", "op": ">", "value": 2000}))


def post_filter_baseline(spark, d):
    return _shown(knn.post_filter(records(spark, d), asked(spark, d), 20, 200, MEDICAL))


def payload_fields(spark, d):
    """Declared payload fields as columns."""
    return filters.hoist(live(spark, d).select("id", "payload"), ["topic", "year"]).select("id", "f_topic", F.round("n_year", 6).alias("n_year"))


# Text


def tokenize(spark, d):
    tk = T.once(table(spark, d, "documents").select("doc_id", "text"), T.tokens("text"), "tk").where("tk IS NOT NULL")
    return tk.select("doc_id", F.size("tk").cast("bigint").alias("n_tokens"), F.array_join(F.slice("tk", 1, 5), " ").alias("first"))


def term_freq(spark, d):
    return T.term_frequencies(table(spark, d, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def suffix_strip(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return words.select(T.strip_suffix(F.col("term")).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))


def idf(spark, d):
    return bm25.Bm25Index.build(table(spark, d, "documents"), "doc_id").idf().select("term", "df", F.round("idf", 6).alias("idf"))


def doc_stats(spark, d):
    return bm25.doc_stats(table(spark, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"), "total")


def bm25_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return _shown(bm25.sparse_search(docs, QUESTION, 20))


def bm25_index_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return _shown(bm25.Bm25Index.build(docs).search(QUESTION, 20))


def bm25_candidates(spark, d):
    """Scores of the records of one topic, with the statistics of all."""
    r = live(spark, d)
    return _shown(bm25.Bm25Index.build(r).search(QUESTION, 20, r.where(filters.compile_filter(MEDICAL))))


def bm25_batch(spark, d):
    """The k best records of its collection for every stored query."""
    best = bm25.batch_search(live(spark, d), table(spark, d, "queries"), "collection_name")
    return best.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


def bm25_changed(spark, d):
    """An index of the even documents, to which all are upserted and from which one is removed again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    gone = docs.where("length(text) > 0").agg(F.min("id")).first()[0]
    index = bm25.Bm25Index.build(docs.where("id % 2 = 0")).upsert(docs)
    words = index.documents().where(F.col("id") == gone)
    return _shown((index if words.isEmpty() else index.remove(gone)).search(QUESTION, 20))


# Fusion


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    r = records(spark, d)
    return knn.dense_search(r, asked(spark, d), 100).select("id", "score"), bm25.sparse_search(r, QUESTION, 100).select("id", "score")


def minmax_norm(spark, d):
    return _shown(fusion.minmax(_sides(spark, d)[0]))


def softmax_norm(spark, d):
    return _shown(fusion.softmax(_sides(spark, d)[0]))


def fuse_weighted(spark, d):
    return _shown(knn.top(fusion.weighted_sum(*_sides(spark, d), 0.7), 20))


def fuse_rrf(spark, d):
    return _shown(knn.top(fusion.reciprocal_rank(_sides(spark, d)), 20))


def fuse_batch(spark, d):
    """Every stored query's results fused by its own alpha: each side normalised within the query, a missing side 0."""
    rows = table(spark, d, "search_results").where("query_id IS NOT NULL AND id IS NOT NULL")
    last = rows.groupBy("query_id", "id").agg(F.max_by(F.struct("dense_score", "sparse_score"), "returned_at").alias("r")).select("query_id", "id", "r.*")
    fused = fusion.fuse_groups(last.join(table(spark, d, "queries").select("query_id", "k", "alpha"), "query_id"))
    return fused.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


def _hybrid(df: DataFrame) -> DataFrame:
    return _shown(df, F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"))


def hybrid_both(spark, d):
    return _hybrid(fusion.hybrid_search(records(spark, d), asked(spark, d), QUESTION, 20))


def hybrid_rrf(spark, d):
    return _hybrid(fusion.hybrid_search(records(spark, d), asked(spark, d), QUESTION, 20, strategy=Fusion("rrf")))


def hybrid_dense_only(spark, d):
    return _hybrid(fusion.hybrid_search(records(spark, d), asked(spark, d), None, 20))


def hybrid_sparse_only(spark, d):
    return _hybrid(fusion.hybrid_search(records(spark, d), None, QUESTION, 20))


# Quantised scans and lists


def int8_params(spark, d):
    p = quantize.int8_params(records(spark, d))
    return p.select(F.col("i").cast("bigint").alias("i"), F.round("dmin", 6).alias("dmin"), F.round("dscale", 8).alias("dscale"))


def int8_codes(spark, d):
    """Codes of every record, as their sum and the sum weighted by place."""
    r = records(spark, d)
    codes = quantize.Int8.fit(r, Metric.DOT).build(r).select("id", F.posexplode("codes").alias("i", "c"))
    return codes.groupBy("id").agg(F.sum(F.col("c").cast("bigint")).alias("total"), F.sum(F.col("c").cast("bigint") * (F.col("i") + 1)).alias("weighted"))


def int8_search(spark, d):
    r = records(spark, d)
    fitted = quantize.Int8.fit(r, Metric.EUCLIDEAN)
    return _shown(fitted.search(fitted.build(r), asked(spark, d), 20))


def binary_codes(spark, d):
    r = records(spark, d)
    return quantize.Binary.fit(r).build(r).select("id", F.col("words")[0].alias("word"))


def binary_search(spark, d):
    r = records(spark, d)
    fitted = quantize.Binary.fit(r)
    return _shown(fitted.search(fitted.build(r), asked(spark, d), 20))


def binary_rerank(spark, d):
    r = records(spark, d)
    b = quantize.Binary.fit(r)
    return _shown(b.rerank(b.build(r), asked(spark, d), 10, 100))


def _stored_lists(spark, d) -> tuple[ivf.IvfIndex, list[str]]:
    """The stored centroids, in the order of their names."""
    c = table(spark, d, "ivf_centroids").where(usable(F.col("centroid")))
    rows = c.groupBy(F.concat_ws("/", "collection_name", F.lpad(F.col("list_id").cast("string"), 6, "0")).alias("name")).agg(F.min("centroid").alias("v")).orderBy("name").collect()
    return ivf.IvfIndex(np.array([r["v"] for r in rows], np.float64), Metric.COSINE), [r["name"] for r in rows]


def _named(assigned: DataFrame, names: list[str]) -> DataFrame:
    return assigned.select("id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("cid") + 1).alias("list"))


def ivf_assign(spark, d):
    """The nearest stored centroid of every record."""
    lists, names = _stored_lists(spark, d)
    return _named(lists.assign(records(spark, d).select("id", "vector")), names)


def ivf_probe(spark, d):
    """The best records of the 16 stored lists nearest to the query."""
    lists, _ = _stored_lists(spark, d)
    return _shown(lists.search(lists.assign(records(spark, d).select("id", "vector")), asked(spark, d), 20))


def ivf_changed(spark, d):
    """Lists of some records, to which all are inserted and from which some are deleted."""
    lists, names = _stored_lists(spark, d)
    r = records(spark, d).select("id", "vector")
    some = lists.assign(r.where("id < 'n'").withColumn("vector", F.reverse("vector")))
    return _named(lists.delete(lists.insert(some, r), r.where("id LIKE '%7'")), names)


def ivf_search(spark, d):
    r = records(spark, d).select("id", "vector")
    index = ivf.IvfIndex.train(r)
    return _shown(index.search(index.assign(r), asked(spark, d), 20))


# SQL dialect


def _sql(statement: str, strict: bool = True, order_all: bool = False):
    def query(spark, d):
        q = "[" + ", ".join(f"{x:.4f}" for x in asked(spark, d)) + "]"
        plan = planner.plan_sql(CONFIG, statement.replace("$q", q), 1, strict, order_all)
        return planner.execute(plan, records(spark, d)).select("id", F.round("score", 6).alias("score"), "payload", "text")

    return query


STATEMENTS = {
    "sql_dense": "SELECT * FROM vectors WHERE VECTOR_SIM(vector, $q) > -2 LIMIT 10",
    "sql_filter": "SELECT id FROM vectors WHERE topic = 'medical' AND year >= 2023 AND VECTOR_SIM(vector, $q) > 0.1 LIMIT 15",
    "sql_or_not": "SELECT id FROM vectors WHERE VECTOR_SIM(vector, $q) > -2 AND (topic = 'medical' OR NOT payload->>'region' = 'EU') LIMIT 15",
    "sql_projection": "SELECT id, topic, text FROM vectors WHERE VECTOR_SIM(vector, $q) > -2 LIMIT 10",
    "sql_or_similar": "SELECT id FROM vectors WHERE (year = 2023 AND topic = 'medical') OR VECTOR_SIM(vector, $q) > 0.5 LIMIT 400",
    "sql_not_similar": "SELECT id FROM vectors WHERE NOT VECTOR_SIM(vector, $q) > 0.1 LIMIT 15",
    "sql_nested_and": "SELECT id FROM vectors WHERE (topic = 'medical' AND VECTOR_SIM(vector, $q) > 0.15) AND year >= 2023 LIMIT 400",
    "sql_two_similar": "SELECT id FROM vectors WHERE VECTOR_SIM(vector, $q) > -0.1 AND VECTOR_SIM(vector, $q) < 0.2 LIMIT 15",
    "sql_order_limit": "SELECT id, year FROM vectors WHERE VECTOR_SIM(vector, $q) >= 0.2 ORDER BY year DESC LIMIT 12;",
}
globals().update({name: _sql(s) for name, s in STATEMENTS.items()})
sql_loose = _sql(STATEMENTS["sql_or_not"], strict=False)
sql_order_all = _sql(STATEMENTS["sql_order_limit"], order_all=True)


# Plans


def plan_sparse(spark, d):
    plan = planner.plan_search(CONFIG, SearchRequest(query_text=QUESTION, k=20), 1)
    return _shown(planner.execute(plan, records(spark, d)))


def plan_hybrid(spark, d):
    """Dense, sparse and a filter: the text's statistics are those of all records."""
    r = records(spark, d)
    plan = planner.plan_search(CONFIG, SearchRequest(vector=tuple(asked(spark, d)), query_text=QUESTION, k=2, filter=MEDICAL), 1)
    return _hybrid(planner.execute(plan, r, bm25.Bm25Index.build(r)))


def plan_choices(spark, d):
    """What the planner decides for sizes and k."""
    sizes = [(n, k) for n in (0, 1, 99, 100, 100_000, 100_001) for k in (1, 10, 3000)]
    rows = [(n, k, round(planner.cost(n, k), 6), planner.uses_ann(n), planner.pre_filters(0.2, n), *[planner.candidate_k(k, h, f) for h in (True, False) for f in (True, False)]) for n, k in sizes]
    return spark.createDataFrame(rows, "n BIGINT, k BIGINT, cost DOUBLE, ann BOOLEAN, pre BOOLEAN, hybrid_filtered BIGINT, hybrid BIGINT, filtered BIGINT, plain BIGINT")


# State


def upsert_latest(spark, d):
    return state(spark, d).select("id", "collection_name", F.unix_seconds("updated_at").alias("updated"), F.col("deleted").cast("bigint").alias("deleted"))


def delete_antijoin(spark, d):
    s = state(spark, d)
    return index.without(s.select("id"), s.where("deleted != 0"))


def collection_stats(spark, d):
    return store.summary(live(spark, d), "collection_name", usable(F.col("vector")))


def point_get(spark, d):
    r = live(spark, d)
    return store.lookup(r, r.agg(F.min("id")).first()[0]).select("id", "collection_name", "payload", "text")


def collection_configs(spark, d):
    """Configurations with their defaults filled in."""
    return store.configs(table(spark, d, "collections")).select("collection_name", "metric", "index_type", "bm25_k1", "bm25_b", "quantization")


def payload_join(spark, d):
    """Records of which one's topic is the other collection's topic: per topic, from both sides' counts."""
    r = live(spark, d).select("id", "payload", "collection_name")
    left = r.where(filters.compile_filter(MEDICAL)).select("id", "payload")
    topics = r.select(F.get_json_object("payload", "$.topic").alias("t")).where("t IS NOT NULL").distinct()
    right = topics.select(F.col("t").alias("id"), F.to_json(F.struct(F.col("t").alias("topic"))).alias("payload"))
    return planner.join_payload(left, right, "topic", "topic").select("id", F.col("r_id").alias("topic"))


# Sources and sinks


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


def store_roundtrip(spark, d):
    """A collection that gets all records, loses one, gets another version of one, and is compacted."""
    r, db = records(spark, d), Db.open(spark, _folder(spark))
    c = db.create_collection_with(CONFIG)
    c.insert_frame(r.select("id", "vector", "payload", "text"))
    low, high = r.agg(F.min("id"), F.max("id")).first()
    c.delete(low)
    c.insert_text(high, [1.0] * 64, {"new": 1}, "new text")
    c.compact()
    return db.collection("vectors").records().select("id", F.size("vector").cast("bigint").alias("dimension"), F.when(F.col("id") == high, F.col("text")).alias("text"))


def store_recover(spark, d):
    """A collection with a snapshot and a log, a failed write among it, opened again: operations applied and records."""
    r, db = records(spark, d).select("id", "vector", "payload", "text"), Db.open(spark, _folder(spark))
    c = db.create_collection_with(CONFIG)
    c.insert_frame(r)
    c.compact()
    c.insert_frame(r.where("id < 'n'"))
    r.limit(0).write.parquet(f"{c.path}/log/batch=99")
    c.files.delete("log/batch=99/_SUCCESS")
    again = db.collection("vectors")
    return spark.createDataFrame([(again.recover(), len(again), db.list_collections())], "applied BIGINT, records BIGINT, names ARRAY<STRING>").select("applied", "records", F.col("names")[0].alias("name"))


def jsonl_roundtrip(spark, d):
    path = _folder(spark)
    records(spark, d).select("id", "vector", "text", F.to_json(F.struct(F.lit(1).alias("v"))).alias("payload")).write.json(path)
    good, _ = files.read_jsonl(spark, path)
    return good.select("id", "text", F.get_json_object("payload", "$.v").cast("bigint").alias("v"), F.round(V.norm("vector"), 4).alias("length"))


def csv_roundtrip(spark, d):
    path = _folder(spark)
    r = records(spark, d).select("id", F.to_json("vector").alias("vector"), "text")
    r.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    good, _ = files.read_csv(spark, path)
    return good.select("id", F.round(V.norm("vector"), 4).alias("length"))


def synthetic_vectors(spark, d):
    s = files.synthetic(spark, 1000, 32)
    return s.select("id", F.size("vector").cast("bigint").alias("dimension"), F.round(V.norm("vector"), 5).alias("length"))


def stream_activity(spark, d):
    """Upserts and deletes by day of the stored operations, read as a stream."""
    source = _folder(spark)
    ops = table(spark, d, "vectors").where("updated_at IS NOT NULL")
    ops.select(*[c.split(" ")[0] for c in ingest.OPERATIONS.split(", ")]).write.parquet(source)
    name = f"activity_{uuid.uuid4().hex}"
    q = ingest.activity(ingest.read_operations(spark, source), "1 day").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.unix_seconds("start").alias("start"), "upserts", "deletes")


# Evaluation


def recall_at_k(spark, d):
    """Recall of the 1-bit scan against the exact one."""
    r, q = records(spark, d), asked(spark, d)
    b = quantize.Binary.fit(r)
    mark = lambda df: df.select(F.lit(1).alias("query_id"), "id")
    return evals.recall_at_k(mark(b.search(b.build(r), q, 50)), mark(knn.dense_search(r, q, 50)), 50).select(F.round("recall", 6).alias("recall"))


def percentile_floor(spark, d):
    return evals.exact_percentile(table(spark, d, "events"), "value", 95, "floor").select(F.round("value", 6).alias("value"))


def percentile_round(spark, d):
    return evals.exact_percentile(table(spark, d, "events"), "value", 99, "round").select(F.round("value", 6).alias("value"))


def percentile_by_type(spark, d):
    return evals.exact_percentile(table(spark, d, "events"), "value", 50, by="event_type").select("event_type", F.round("value", 6).alias("p50"))


_NOT_QUERIES = {"state", "live", "usable", "records", "asked", "table", "latest", "dataclass"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    mine = {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and k not in _NOT_QUERIES and k.islower() and k != "queries"}
    return {k: v for k, v in mine.items() if getattr(v, "__module__", "") == __name__}
