"""SQL of the training-data queries whose results SQL can express; the others are tested against brute force."""

from __future__ import annotations

_LIVE = "live AS (SELECT id, collection_name FROM (SELECT * FROM vectors WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) WHERE deleted = 0)"

_VECTORS = (
    "rec AS (SELECT id, collection_name, vector::DOUBLE[] AS v FROM (SELECT * FROM vectors WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) "
    "WHERE deleted = 0 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
)

_LAST = "r AS (SELECT * FROM search_results WHERE query_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY returned_at DESC) = 1)"

_RANKS = (
    _LAST
    + ", x AS (SELECT query_id, id, k, list_sort(["
    + ", ".join(f"percent_rank() OVER (PARTITION BY query_id ORDER BY {c} NULLS FIRST)" for c in ("dense_score", "sparse_score", "score"))
    + "]) AS levels FROM r JOIN (SELECT query_id, max(k) AS k FROM queries GROUP BY query_id) USING (query_id)), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY levels DESC, id) AS place FROM x)"
)

_WEIGHTS = (
    _LIVE
    + ", p AS (SELECT collection_name, id, term, max(raw_count) AS c FROM postings SEMI JOIN live USING (id, collection_name) WHERE raw_count > 0 AND term IS NOT NULL GROUP BY ALL), "
    "n AS (SELECT collection_name, count(DISTINCT id) AS n FROM p GROUP BY ALL), f AS (SELECT collection_name, term, count(*) AS df FROM p GROUP BY ALL), "
    "l AS (SELECT collection_name, id, sum(c) AS dl, count(*) AS terms FROM p GROUP BY ALL), "
    "w AS (SELECT id, term, terms, c / dl * ln((n - df + 0.5) / (df + 0.5) + 1) AS w FROM p JOIN n USING (collection_name) JOIN f USING (collection_name, term) JOIN l USING (collection_name, id)), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC) AS k, lead(w) OVER (PARTITION BY id ORDER BY w DESC) AS next FROM w)"
)

_WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _runs(key: str, text: str, table: str, n: int) -> str:
    """Every sequence of n words, once a row."""
    w = _WORDS.format(t=text)
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS run FROM (SELECT {key}, {w} AS w FROM {table} WHERE {text} IS NOT NULL) WHERE len(w) >= {n}"


_TEXTS = (
    "st AS (SELECT id, text, vector FROM (SELECT * FROM vectors WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) WHERE deleted = 0), "
    "t AS (SELECT id, "
    + _WORDS.format(t="text")
    + r" AS w FROM st WHERE NOT regexp_full_match(text, '\s*')), sh AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM t WHERE len(w) >= 3), "
    "n AS (SELECT id, count(*) AS n FROM sh GROUP BY id), j AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL), "
    "v AS (SELECT id, vector::DOUBLE[] AS v FROM st WHERE (text IS NULL OR regexp_full_match(text, '\\s*')) AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0), "
    "l AS (SELECT a, b FROM j JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c) UNION SELECT a.id, b.id FROM v a JOIN v b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.98), "
    "e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)"
)


_SPANS = (
    "s AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)), "
    "m AS (SELECT h FROM s GROUP BY h HAVING count(DISTINCT doc_id) > 1), k AS (SELECT doc_id, i FROM s SEMI JOIN m USING (h)), "
    "j AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS f FROM k), "
    "n AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM j), sp AS (SELECT doc_id, min(i) - 1 AS start, max(i) + 299 AS stop FROM n GROUP BY doc_id, nth)"
)

_NEAR = (
    _VECTORS.replace("SELECT id, collection_name,", "SELECT id, collection_name, mmap_index,", 1)
    + ", s AS (SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS similarity FROM rec a JOIN rec b ON a.collection_name = b.collection_name AND a.id <> b.id WHERE a.mmap_index % 20 = 0), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 12) DESC, neighbour) AS rank FROM s)"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_knn": f"WITH {_NEAR} SELECT id, rank, neighbour, round(similarity, 6) AS similarity FROM t WHERE rank <= 5",
        "p2_recall": f"WITH {_NEAR} SELECT count(DISTINCT id) AS asked, count(*) AS expected, TRUE AS reached FROM t WHERE rank <= 5",
        "p2_found": f"WITH {_VECTORS}, s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM rec a JOIN rec b ON a.collection_name = b.collection_name AND a.id <> b.id), "
        "t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t WHERE s >= 0.9",
        "p3_found": f"WITH RECURSIVE {_TEXTS} SELECT DISTINCT a AS id_a, b AS id_b FROM reach WHERE a < b",
        "p4_found": f"WITH {_WEIGHTS} SELECT id, term FROM o WHERE k = 1 AND terms >= 2 AND w >= 1.7 * next",
        "p5_found": f"WITH {_RANKS} SELECT query_id, id FROM p WHERE place <= k",
        "p5_ranking": f"WITH {_RANKS} SELECT query_id, place, id, round(levels[1], 6) AS weakest FROM p WHERE place <= k",
        "p6_found": f"SELECT DISTINCT doc_id, item_id FROM ({_runs('doc_id', 'text', 'documents', 10)}) JOIN ({_runs('item_id', 'passage', 'eval_passages', 10)}) USING (run)",
        "p6_leaks": f"WITH i AS ({_runs('item_id', 'passage', 'eval_passages', 10).replace('SELECT DISTINCT', 'SELECT', 1)}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id), d AS ({_runs('doc_id', 'text', 'documents', 10)}), "
        "c AS (SELECT doc_id, item_id, count(*) AS runs FROM d JOIN i USING (run) GROUP BY ALL) SELECT doc_id, item_id, runs, round(runs / n, 6) AS share FROM c JOIN n USING (item_id)",
        "p8_spans": f"WITH {_SPANS} SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS stop FROM sp",
        "p8_shared": f"WITH {_SPANS}, a AS (SELECT doc_id, sum(stop - start) AS c, count(*) AS n FROM sp GROUP BY doc_id) SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars, coalesce(c, 0)::BIGINT AS shared_chars, "
        "coalesce(n, 0)::BIGINT AS spans, CASE WHEN length(text) > 0 THEN round(coalesce(c, 0) / length(text), 6) ELSE 0.0 END::DOUBLE AS share FROM documents LEFT JOIN a USING (doc_id)",
        "p8_found": "WITH s AS (SELECT DISTINCT doc_id, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)), "
        "m AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1), k AS (SELECT doc_id, h FROM s SEMI JOIN m USING (h)) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id",
    }
