import math
from collections import Counter

import pytest

from brindle.errors import InvalidQuery, NotFound
from brindle.functions import text as T
from brindle.operators import bm25, fusion
from brindle.types import Fusion


def tokens(spark, text, **k):
    return spark.createDataFrame([(text,)], "t STRING").select(T.tokens("t", **k)).first()[0]


def test_tokens(spark):
    assert tokens(spark, "hello, world! foo-bar baz.qux") == ["hello", "world", "foo", "bar", "baz", "qux"]
    assert tokens(spark, "a I go running") == ["go", "running"]
    assert tokens(spark, "Don't 'quote' it's") == ["don't", "quote", "it's"]
    assert tokens(spark, "ä x " + "y" * 65) == ["ä"]
    assert tokens(spark, "") == [] and tokens(spark, None) is None
    assert tokens(spark, "creation running used", suffixes=True) == ["crea", "runn", "used"]
    assert len(tokens(spark, "word " * 200_000)) == 200_000
    assert T.query_tokens("The Quick, brown") == ["the", "quick", "brown"]


DOCS = [("1", "rust rust systems"), ("2", "rust language"), ("3", "python"), ("4", ""), ("5", None), ("6", "the of"), ("7", "rust language")]


def brute(q):
    tk = {i: [w for w in t.split() if w not in T.STOPWORDS] for i, t in DOCS if t}
    tk = {i: t for i, t in tk.items() if t}
    n, avg = len(tk), sum(map(len, tk.values())) / len(tk)
    out = {}
    for i, t in tk.items():
        c, s = Counter(t), 0
        for w in T.query_tokens(q):
            df = sum(w in x for x in tk.values())
            if c[w]:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if any(c[w] for w in T.query_tokens(q)):
            out[i] = s
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


@pytest.mark.parametrize("q", ["rust", "rust rust language", "python the", "nothing"])
def test_bm25(spark, q, tmp_path):
    df = spark.createDataFrame(DOCS, "id STRING, text STRING")
    index = bm25.Bm25Index.build(df)
    for got in (index.search(q), bm25.sparse_search(df, q)):
        assert [(r["id"], pytest.approx(r["score"])) for r in got.collect()] == brute(q)
    assert index.doc_count() == 4
    only = index.search(q, 10, spark.createDataFrame([("2",), ("3",)], "id STRING")).collect()
    assert [(r["id"], pytest.approx(r["score"])) for r in only] == [x for x in brute(q) if x[0] in "23"]
    index.save(str(tmp_path / "p"))
    assert bm25.Bm25Index.load(spark, str(tmp_path / "p")).search(q).count() == len(brute(q))


def test_bm25_changes(spark):
    df = spark.createDataFrame(DOCS, "id STRING, text STRING")
    index = bm25.Bm25Index.build(df)
    changed = index.upsert(spark.createDataFrame([("3", "rust")], "id STRING, text STRING"))
    assert changed.search("python").count() == 0 and changed.search("rust").count() == 4
    assert index.remove("1").doc_count() == 3
    with pytest.raises(NotFound):
        index.remove("4")
    assert bm25.Bm25Index.build(df.limit(0)).search("rust").count() == 0
    assert bm25.sparse_search(df.limit(0), "rust").count() == 0


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "id STRING, score DOUBLE")


def values(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_normalise(spark):
    assert values(fusion.minmax(scored(spark, [("a", 0.0), ("b", 0.5), ("c", 1.0)]))) == {"a": 0, "b": 0.5, "c": 1}
    assert set(values(fusion.minmax(scored(spark, [("a", 0.7), ("b", 0.7)]))).values()) == {1.0}
    assert values(fusion.minmax(scored(spark, []))) == {}
    assert sum(values(fusion.softmax(scored(spark, [("a", 1.0), ("b", 300.0)]))).values()) == pytest.approx(1)


def test_fuse(spark):
    d, s, none = scored(spark, [("a", 0.9), ("b", 0.8), ("c", 0.7)]), scored(spark, [("b", 5.0), ("c", 4.0), ("a", 3.0)]), scored(spark, [])
    rrf = fusion.fuse(d, s, 3, strategy=Fusion("rrf")).collect()
    assert rrf[0]["id"] == "b" and rrf[0]["score"] == pytest.approx(1 / 62 + 1 / 61) and rrf[0]["sparse_score"] == 5
    assert fusion.fuse(d, s, 3, 1.0).first()["id"] == "a" and fusion.fuse(d, s, 3, 0.0).first()["id"] == "b"
    raw = fusion.fuse(d, none, 3).collect()
    assert [r["score"] for r in raw] == [0.9, 0.8, 0.7] and raw[0]["sparse_score"] is None
    assert fusion.fuse(none, none, 3).collect() == []
    assert fusion.oversample_k(10) == 50


def test_hybrid(spark):
    rows = [(str(i), [float(i), i + 1.0, 0.5, 1.0], f"machine learning number {i}" if i % 2 else "cooking", 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id STRING, vector ARRAY<FLOAT>, text STRING, score DOUBLE")
    both = fusion.hybrid_search(df, [9.0, 10.0, 0.5, 1.0], "machine", 4).collect()
    assert len(both) == 4 and both[0]["id"] == "9" and both[0]["sparse_score"] > 0
    assert {r["id"] for r in fusion.hybrid_search(df, None, "machine", 10).collect()} == {"1", "3", "5", "7", "9"}
    for bad in ({}, {"text": "x", "alpha": 2}):
        with pytest.raises(InvalidQuery):
            fusion.hybrid_search(df, **bad)


def test_text_search_filters_first(spark):
    from brindle.plans.planner import execute, plan_search
    from brindle.types import CollectionConfig, SearchRequest

    rows = [(f"r{i:02d}", [1.0, 0.0], '{"year": %d}' % (2000 + (i == 29)), "slow backup " + "of a disk " * i) for i in range(30)]
    df = spark.createDataFrame(rows, "id STRING, vector ARRAY<DOUBLE>, payload STRING, text STRING")
    kept = {"field": "year", "op": "=", "value": 2001}
    assert [r["id"] for r in fusion.hybrid_search(df, None, "backup", 2, filter=kept).collect()] == ["r29"]
    plan = plan_search(CollectionConfig("docs", 2), SearchRequest("docs", None, "backup", 2, filter=kept), 30)
    assert [r["id"] for r in execute(plan, df).collect()] == ["r29"]
