"""SQL of ``brindle.queries`` for DuckDB, over the same tables."""

from __future__ import annotations

from brindle.functions.text import STOPWORDS, SUFFIXES, query_tokens
from brindle.queries import QUESTION

_STATE = "state AS (SELECT * FROM vectors WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_LIVE = _STATE + ", live AS (SELECT * FROM state WHERE deleted = 0)"
_OK = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"
_REC = _LIVE + f", rec AS (SELECT * REPLACE (vector::DOUBLE[] AS vector) FROM live WHERE {_OK.format(v='vector')}), q AS (SELECT vector AS qv FROM rec ORDER BY id LIMIT 1)"
_TOP = "ORDER BY round(score, 9) DESC, id LIMIT"
_COS = "list_cosine_similarity(vector, qv)"
_L2 = "1 / (1 + list_distance(vector, qv))"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens(text: str, stop: bool = True) -> str:
    words = rf"list_transform(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}'']+'), lambda w: lower(trim(w, '''')))"
    drop = f" AND NOT list_contains({_list(STOPWORDS)}, w)" if stop else ""
    return f"list_filter({words}, lambda w: strlen(w) BETWEEN 2 AND 64{drop})"


def _dense(score: str, k: int = 20, where: str = "TRUE") -> str:
    return f"WITH {_REC} SELECT id, round(score, 6) AS score FROM (SELECT id, {score} AS score FROM rec, q WHERE {where} {_TOP} {k})"


# Payload values; a cut-off payload has none.
_J = "(CASE WHEN json_valid(payload) THEN payload::JSON END)"


def _text(path: str) -> str:
    return f"(CASE WHEN json_type({_J}, '{path}') = 'VARCHAR' THEN json_extract_string({_J}, '{path}') END)"


def _number(path: str) -> str:
    own = f"CASE WHEN json_type({_J}, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string({_J}, '{path}')::DOUBLE END"
    spelled = rf"CASE WHEN regexp_full_match({_text(path)}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({_text(path)} AS DOUBLE) END"
    return f"coalesce({own}, {spelled})"


_MEDICAL = f"{_text('$.topic')} = 'medical'"
_YEAR = _number("$.year")
_WHERE = {
    "filter_eq": _MEDICAL,
    "filter_neq": f"json_type({_J}, '$.region') IS NOT NULL AND coalesce({_text('$.region')} <> 'EU', TRUE)",
    "filter_range": f"{_YEAR} >= 2023 AND {_YEAR} < 2025",
    "filter_like": f"{_text('$.region')} LIKE '%A%'",
    "filter_nested": f"{_text('$.meta.lang')} = 'en'",
    "filter_and": f"{_MEDICAL} AND {_YEAR} = 2023",
    "filter_coerce": f"{_YEAR} = 2023",
    "filter_id": "id LIKE 'vec%'",
    "filter_unknown": "FALSE",
    "filter_flag": f"json_type({_J}, '$.topic') IS NOT NULL AND coalesce(({_J}->'$.topic')::VARCHAR <> 'true', TRUE) AND {_YEAR} <= 2024",
    "filter_null": f"json_type({_J}, '$.region') = 'NULL'",
}


def _bm25(source: str, key: str, k: int, candidates: str = "TRUE") -> str:
    """CTEs ``tk`` to ``bm`` (id, score) over ``source``."""
    words = query_tokens(QUESTION)
    terms = ", ".join(f"('{w}', {words.count(w)})" for w in dict.fromkeys(words))
    return (
        f"tk AS (SELECT {key} AS id, {_tokens('text')} AS tk FROM {source} WHERE text IS NOT NULL), docs AS (SELECT id, tk, len(tk) AS dl FROM tk WHERE len(tk) > 0), "
        f"st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs), terms(term, w) AS (VALUES {terms}), "
        "tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(tk) AS term FROM docs) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
        "bm AS (SELECT id, sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) AS score "
        f"FROM tf JOIN terms USING (term) JOIN df USING (term), st WHERE {candidates} GROUP BY id {_TOP} {k})"
    )


_SIDES = f"WITH {_REC}, d AS (SELECT id, {_COS} AS score FROM rec, q {_TOP} 100), {_bm25('rec', 'id', 100)}"
_DN = "dn AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-9 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM d)"
_SN = _DN.replace("dn AS", "sn AS").replace("FROM d)", "FROM bm)")
_RR = "r AS (SELECT id, sum(s) AS score FROM (SELECT id, 1 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM d UNION ALL SELECT id, 1 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM bm) GROUP BY id)"
_HD = f"WITH {_REC}, d AS (SELECT id, {_COS} AS score FROM rec, q {_TOP} 100)"
_HB = _HD + ", " + _bm25("rec", "id", 100, "id IN (SELECT id FROM d)")
_HOUT = "SELECT id, round(f.score, 6) AS score, round(d.score, 6) AS dense_score, round(bm.score, 6) AS sparse_score FROM f LEFT JOIN d USING (id) LEFT JOIN bm USING (id) ORDER BY round(f.score, 9) DESC, id LIMIT 20"
_WS = "f AS (SELECT id, 0.7 * coalesce(dn.score, 0) + 0.3 * coalesce(sn.score, 0) AS score FROM dn FULL JOIN sn USING (id))"

_PARAM = "prm AS (SELECT i, min(x) AS dmin, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1.0 END AS dscale FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM rec) GROUP BY i)"
_CODE = _PARAM + ", c AS (SELECT id, i, least(greatest(round((x - dmin) / dscale), 0), 255)::BIGINT - 128 AS c FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM rec) JOIN prm USING (i))"
_BITS = (
    "thr AS (SELECT i, avg(x) AS t FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM rec) GROUP BY i), "
    "b AS (SELECT id, sum(CASE WHEN x > t THEN (CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (i - 1)) END) ELSE 0 END)::BIGINT AS word FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM rec) JOIN thr USING (i) GROUP BY id), "
    "qb AS (SELECT word AS qw FROM b ORDER BY id LIMIT 1), h AS (SELECT id, 1 - bit_count(xor(word, qw)) / 64 AS score FROM b, qb)"
)
_CENT = f"cent AS (SELECT collection_name, list_id, min(centroid)::DOUBLE[] AS c FROM ivf_centroids WHERE {_OK.format(v='centroid')} GROUP BY ALL)"
_Q4 = _REC.replace("SELECT vector AS qv", "SELECT list_transform(vector, lambda x: round(x, 4)) AS qv")


def _sql(where: str, k: int, payload: str = "payload", text: str = "NULL::VARCHAR") -> str:
    return f"WITH {_Q4}, s AS (SELECT *, {_COS} AS score FROM rec, q), t AS (SELECT * FROM s WHERE {where} {_TOP} {k}) SELECT id, round(score, 6) AS score, {payload} AS payload, {text} AS text FROM t"


def _kept(key: str) -> str:
    """The payload with one key only."""
    v = f"json_extract({_J}, '$.{key}')"
    return f"CASE WHEN json_type({_J}) = 'OBJECT' THEN CASE WHEN {v} IS NULL THEN '{{}}' ELSE '{{\"{key}\":' || {v}::VARCHAR || '}}' END ELSE payload END"


_NONE = f"CASE WHEN json_type({_J}) = 'OBJECT' THEN '{{}}' ELSE payload END"


def _strip(w: str) -> str:
    cases = " ".join(f"WHEN strlen({w}) > {len(s) + 3} AND suffix({w}, '{s}') THEN left({w}, length({w}) - {len(s)})" for s in SUFFIXES)
    return f"CASE {cases} ELSE {w} END"


_DOCTERMS = f"SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents"


def oracle_sql() -> dict[str, str]:
    out = {
        "dense_cosine": _dense(_COS),
        "dense_euclidean": _dense(_L2),
        "dense_dot": _dense("list_dot_product(vector, qv)"),
        "vector_normalize": f"WITH {_LIVE}, v AS (SELECT id, vector::DOUBLE[] AS v FROM live WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: isnan(x))) = 0), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v) "
        "SELECT id, round(CASE WHEN n < 1e-10 THEN n ELSE sqrt(list_dot_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n))) END, 6) AS length, round(CASE WHEN n < 1e-10 THEN v[1] ELSE v[1] / n END, 6) AS first FROM n",
        "pairwise_similarity": f"WITH {_REC} SELECT pair_id, round(list_cosine_similarity(a.vector, b.vector), 6) AS cosine, round(list_distance(a.vector, b.vector), 6) AS euclidean, round(list_dot_product(a.vector, b.vector), 5) AS dot FROM pair_probe JOIN rec a ON a.id = id_a JOIN rec b ON b.id = id_b",
        "batch_knn": f"WITH {_REC}, {_CENT}, s AS (SELECT collection_name || '/' || list_id AS query_id, id, score FROM (SELECT cent.collection_name, list_id, id, list_cosine_similarity(c, vector) AS score FROM cent, rec)), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
        "ground_truth_l2": f"WITH {_REC}, s AS (SELECT vec_id::VARCHAR AS query_id, id, 1 / (1 + list_distance(embedding::DOUBLE[], vector)) AS score FROM embeddings, rec), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
        "dense_filtered_selective": _dense(_COS, 20, f"{_MEDICAL} AND {_YEAR} = 2023"),
        "dense_filtered_weak": _dense(_COS, 20, f"{_YEAR} > 2000"),
        "post_filter_baseline": f"WITH {_REC}, t AS (SELECT id, payload, {_COS} AS score FROM rec, q {_TOP} 200) SELECT id, round(score, 6) AS score FROM t WHERE {_MEDICAL} {_TOP} 20",
        "payload_fields": f"WITH {_LIVE} SELECT id, CASE WHEN json_type({_J}, '$.topic') = 'VARCHAR' THEN json_extract_string({_J}, '$.topic') ELSE json_extract({_J}, '$.topic')::VARCHAR END AS f_topic, round({_YEAR}, 6) AS n_year FROM live",
        "tokenize": f"SELECT doc_id, len(tk)::BIGINT AS n_tokens, array_to_string(tk[1:5], ' ') AS first FROM (SELECT doc_id, {_tokens('text')} AS tk FROM documents WHERE text IS NOT NULL)",
        "term_freq": f"SELECT doc_id, term, count(*) AS tf FROM ({_DOCTERMS}) GROUP BY ALL",
        "suffix_strip": f"WITH w AS (SELECT term, count(*) AS n FROM ({_DOCTERMS}) GROUP BY term) SELECT {_strip('term')} AS stem, sum(n)::BIGINT AS n, count(*) AS forms FROM w GROUP BY ALL",
        "idf": f"WITH t AS ({_DOCTERMS}), n AS (SELECT count(DISTINCT doc_id) AS n FROM t), f AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f, n",
        "doc_stats": f"WITH d AS (SELECT len({_tokens('text')}) AS dl FROM documents WHERE text IS NOT NULL) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl, coalesce(sum(dl), 0)::BIGINT AS total FROM d WHERE dl > 0",
        "bm25_search": f"WITH {_bm25('documents', 'doc_id', 20)} SELECT id, round(score, 6) AS score FROM bm",
        "bm25_candidates": f"WITH {_LIVE}, {_bm25('live', 'id', 20, f'id IN (SELECT id FROM live WHERE {_MEDICAL})')} SELECT id, round(score, 6) AS score FROM bm",
        "bm25_batch": f"WITH {_LIVE}, docs AS (SELECT collection_name, id, tk, len(tk) AS dl FROM (SELECT collection_name, id, {_tokens('text')} AS tk FROM live WHERE text IS NOT NULL) WHERE len(tk) > 0), "
        "tf AS (SELECT collection_name, id, dl, term, count(*) AS tf FROM (SELECT collection_name, id, dl, unnest(tk) AS term FROM docs) GROUP BY ALL), df AS (SELECT collection_name, term, count(*) AS df FROM tf GROUP BY ALL), "
        f"st AS (SELECT collection_name, count(*) AS n, avg(dl) AS avgdl FROM docs GROUP BY ALL), t AS (SELECT query_id, collection_name, k, term, count(*) AS w FROM (SELECT query_id, collection_name, k, unnest({_tokens('query_text', False)}) AS term FROM queries WHERE query_text IS NOT NULL) GROUP BY ALL), "
        "s AS (SELECT query_id, k, id, sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) AS score FROM t JOIN tf USING (collection_name, term) JOIN df USING (collection_name, term) JOIN st USING (collection_name) GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= k",
        "minmax_norm": f"{_SIDES}, {_DN} SELECT id, round(score, 6) AS score FROM dn",
        "softmax_norm": f"{_SIDES}, e AS (SELECT id, exp(score - max(score) OVER ()) AS e FROM d) SELECT id, round(e / sum(e) OVER (), 6) AS score FROM e",
        "fuse_weighted": f"{_SIDES}, {_DN}, {_SN}, {_WS} SELECT id, round(score, 6) AS score FROM f {_TOP} 20",
        "fuse_rrf": f"{_SIDES}, {_RR} SELECT id, round(score, 6) AS score FROM r {_TOP} 20",
        "fuse_batch": "WITH l AS (SELECT * FROM search_results WHERE query_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY returned_at DESC) = 1), "
        + "n AS (SELECT query_id, id, "
        + ", ".join(f"CASE WHEN {c} IS NULL THEN 0.0 WHEN max({c}) OVER w - min({c}) OVER w < 1e-9 THEN 1.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c[0]}n" for c in ("dense_score", "sparse_score"))
        + " FROM l WINDOW w AS (PARTITION BY query_id)), s AS (SELECT query_id, k, id, coalesce(alpha, 0.7) * dn + (1 - coalesce(alpha, 0.7)) * sn AS score FROM n JOIN queries USING (query_id)), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= k",
        "hybrid_both": f"{_HB}, {_DN}, {_SN}, {_WS} {_HOUT}",
        "hybrid_rrf": f"{_HB}, {_RR}, f AS (SELECT * FROM r) {_HOUT}",
        "hybrid_dense_only": f"{_HD} SELECT id, round(score, 6) AS score, round(score, 6) AS dense_score, NULL::DOUBLE AS sparse_score FROM d {_TOP} 20",
        "hybrid_sparse_only": f"WITH {_REC}, {_bm25('rec', 'id', 100)} SELECT id, round(score, 6) AS score, NULL::DOUBLE AS dense_score, round(score, 6) AS sparse_score FROM bm {_TOP} 20",
        "int8_params": f"WITH {_REC}, {_PARAM} SELECT i::BIGINT - 1 AS i, round(dmin, 6) AS dmin, round(dscale, 8) AS dscale FROM prm",
        "int8_codes": f"WITH {_REC}, {_CODE} SELECT id, sum(c)::BIGINT AS total, sum(c * i)::BIGINT AS weighted FROM c GROUP BY id",
        "int8_search": f"WITH {_REC}, {_CODE}, dec AS (SELECT id, i, dmin + (c + 128) * dscale AS x FROM c JOIN prm USING (i)), qq AS (SELECT unnest(qv) AS y, generate_subscripts(qv, 1) AS i FROM q), s AS (SELECT id, 1 / (1 + sqrt(sum((x - y) * (x - y)))) AS score FROM dec JOIN qq USING (i) GROUP BY id) SELECT id, round(score, 6) AS score FROM s {_TOP} 20",
        "binary_codes": f"WITH {_REC}, {_BITS} SELECT id, word FROM b",
        "binary_search": f"WITH {_REC}, {_BITS} SELECT id, round(score, 6) AS score FROM h {_TOP} 20",
        "binary_rerank": f"WITH {_REC}, {_BITS}, cand AS (SELECT id FROM h {_TOP} 100) SELECT id, round(score, 6) AS score FROM (SELECT id, {_L2} AS score FROM rec JOIN cand USING (id), q) {_TOP} 10",
        "ivf_assign": f"WITH {_REC}, {_CENT}, s AS (SELECT id, cent.collection_name || '/' || lpad(list_id::VARCHAR, 6, '0') AS list, 1 - list_cosine_similarity(vector, c) AS d FROM rec, cent) SELECT id, list FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d, 9), list) = 1",
        "sql_dense": _sql("TRUE", 10, text="text"),
        "sql_filter": _sql(f"{_MEDICAL} AND {_YEAR} >= 2023 AND score > 0.1", 15, _NONE),
        "sql_or_not": _sql(f"coalesce({_MEDICAL}, FALSE) OR NOT coalesce({_text('$.region')} = 'EU', FALSE)", 15, _NONE),
        "sql_loose": _sql("TRUE", 15, _NONE),
        "sql_projection": _sql("TRUE", 10, _kept("topic"), "text"),
        "sql_order_limit": _sql("score >= 0.2", 12, _kept("year")),
        "upsert_latest": f"WITH {_STATE} SELECT id, collection_name, epoch(updated_at)::BIGINT AS updated, deleted::BIGINT AS deleted FROM state",
        "delete_antijoin": f"WITH {_STATE} SELECT id FROM state WHERE NOT deleted <> 0",
        "collection_stats": f"WITH {_LIVE} SELECT collection_name, count(*) AS records, coalesce(sum(CASE WHEN {_OK.format(v='vector')} THEN 1 ELSE 0 END), 0)::BIGINT AS vectors, sum(CASE WHEN length(trim(text)) > 0 THEN 1 WHEN text IS NULL THEN NULL ELSE 0 END)::BIGINT AS texts, max(epoch(updated_at))::BIGINT AS updated FROM live GROUP BY collection_name",
        "point_get": f"WITH {_LIVE} SELECT id, collection_name, payload, text FROM live WHERE id = (SELECT min(id) FROM live)",
        "collection_configs": "SELECT collection_name, coalesce(config->>'$.metric', 'cosine') AS metric, coalesce(config->>'$.index_type', 'HNSW') AS index_type, coalesce((config->>'$.bm25_k1')::DOUBLE, 1.5) AS bm25_k1, coalesce((config->>'$.bm25_b')::DOUBLE, 0.75) AS bm25_b, coalesce(config->>'$.quantization', 'None') AS quantization FROM collections",
        "payload_join": f"WITH {_LIVE} SELECT id, {_text('$.topic')} AS topic FROM live WHERE {_MEDICAL}",
        "store_roundtrip": f"WITH {_REC} SELECT id, 64::BIGINT AS dimension, CASE WHEN id = (SELECT max(id) FROM rec) THEN 'new text' END AS text FROM rec WHERE id <> (SELECT min(id) FROM rec)",
        "jsonl_roundtrip": f"WITH {_REC} SELECT id, text, 1::BIGINT AS v, round(sqrt(list_dot_product(vector, vector)), 4) AS length FROM rec",
        "csv_roundtrip": f"WITH {_REC} SELECT id, round(sqrt(list_dot_product(vector, vector)), 4) AS length FROM rec",
        "synthetic_vectors": "SELECT 'syn-' || i AS id, 32::BIGINT AS dimension, 1.0::DOUBLE AS length FROM range(1000) t(i)",
        "stream_activity": "SELECT epoch(date_trunc('day', updated_at AT TIME ZONE 'UTC'))::BIGINT AS start, sum(CASE WHEN deleted = 0 THEN 1 WHEN deleted IS NOT NULL THEN 0 END)::BIGINT AS upserts, sum(CASE WHEN deleted <> 0 THEN 1 WHEN deleted IS NOT NULL THEN 0 END)::BIGINT AS deletes FROM vectors WHERE updated_at IS NOT NULL GROUP BY ALL",
        "recall_at_k": f"WITH {_REC}, {_BITS}, f AS (SELECT id FROM h {_TOP} 50), t AS (SELECT id FROM (SELECT id, {_COS} AS score FROM rec, q) {_TOP} 50) SELECT round(count(*) / 50, 6) AS recall FROM f JOIN t USING (id)",
        "percentile_floor": "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT round(value, 6) AS value FROM v WHERE i = floor((n - 1) * 0.95)",
        "percentile_round": "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT round(value, 6) AS value FROM v WHERE i = round((n - 1) * 0.99)",
        "percentile_by_type": "WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(value, 6) AS p50 FROM v WHERE i = floor((n - 1) * 0.5)",
        "pairwise_distance": f"WITH {_REC}, x AS (SELECT pair_id, 1 - list_cosine_similarity(a.vector, b.vector) AS c, list_distance(a.vector, b.vector) AS e, 1 - list_dot_product(a.vector, b.vector) AS p FROM pair_probe JOIN rec a ON a.id = id_a JOIN rec b ON b.id = id_b) "
        "SELECT pair_id, round(c, 5) AS cosine, round(e, 5) AS euclidean, round(p, 5) AS dot, round(1 - c, 5) AS cosine_score, round(1 / (1 + e), 5) AS euclidean_score, round(1 - p, 5) AS dot_score FROM x",
        "sql_or_similar": _sql(f"coalesce({_YEAR} = 2023 AND {_MEDICAL}, FALSE) OR score > 0.5", 400, _NONE),
        "sql_not_similar": _sql("NOT score > 0.1", 15, _NONE),
        "sql_nested_and": _sql(f"{_MEDICAL} AND {_YEAR} >= 2023 AND score > 0.15", 400, _NONE),
        "sql_two_similar": _sql("score > -0.1 AND score < 0.2", 15, _NONE),
        "sql_order_all": _sql("score >= 0.2", 12, _kept("year")).replace(_TOP, f"ORDER BY {_YEAR} DESC NULLS LAST, {_text('$.year')} DESC NULLS LAST, id LIMIT"),
        "plan_sparse": f"WITH {_REC}, {_bm25('rec', 'id', 20)} SELECT id, round(score, 6) AS score FROM bm",
        "plan_hybrid": f"WITH {_REC}, d AS (SELECT id, {_COS} AS score FROM rec, q WHERE {_MEDICAL} {_TOP} 100), {_bm25('rec', 'id', 100, 'id IN (SELECT id FROM d)')}, {_DN}, {_SN}, {_WS} {_HOUT}".replace("LIMIT 20", "LIMIT 2"),
        "plan_choices": "WITH x AS (SELECT n, k FROM (VALUES (0), (1), (99), (100), (100000), (100001)) a(n), (VALUES (1), (10), (3000)) b(k)) SELECT n::BIGINT AS n, k::BIGINT AS k, round(CASE WHEN n > 0 THEN ln(n) * k * 0.1 ELSE 0 END, 6)::DOUBLE AS cost, n >= 100 AS ann, n > 100000 AS pre, "
        + ", ".join(f"greatest(least(k * {f}, 10000), k)::BIGINT AS {c}" for c, f in (("hybrid_filtered", 10), ("hybrid", 5), ("filtered", 3), ("plain", 1))) + " FROM x",
        "store_recover": f"WITH {_REC} SELECT count(*) FILTER (id < 'n') AS applied, count(*) AS records, 'vectors' AS name FROM rec",
        "bm25_changed": f"WITH gone AS (SELECT min(doc_id) AS g FROM documents WHERE length(text) > 0), kept AS (SELECT * FROM documents, gone WHERE doc_id <> g), {_bm25('kept', 'doc_id', 20)} SELECT id, round(score, 6) AS score FROM bm",
        "ivf_probe": f"WITH {_REC}, {_CENT}, near AS (SELECT collection_name || '/' || lpad(list_id::VARCHAR, 6, '0') AS list, 1 - list_cosine_similarity(c, qv) AS d FROM cent, q ORDER BY d, list LIMIT 16), "
        "s AS (SELECT id, vector, cent.collection_name || '/' || lpad(list_id::VARCHAR, 6, '0') AS list, 1 - list_cosine_similarity(vector, c) AS d FROM rec, cent), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d, 9), list) = 1) "
        f"SELECT id, round(score, 6) AS score FROM (SELECT id, {_COS} AS score FROM a SEMI JOIN near USING (list), q {_TOP} 20)".replace("a SEMI JOIN near USING (list), q", "(SELECT * FROM a SEMI JOIN near USING (list)) z, q"),
    }
    out["bm25_index_search"] = out["bm25_search"]
    out["dense_filtered_indexed"] = out["dense_filtered_selective"]
    out["ivf_changed"] = f"SELECT id, list FROM ({out['ivf_assign']}) WHERE NOT id LIKE '%7'"
    out |= {name: f"WITH {_LIVE} SELECT id FROM live WHERE {where}" for name, where in _WHERE.items()}
    return out
