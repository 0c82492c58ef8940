import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.errors import CollectionAlreadyExists, CollectionNotFound, DimensionMismatch, InvalidQuery, NotFound, SerializationError
from brindle.sources import files
from brindle.sources.store import Db
from brindle.streaming import ingest
from brindle.types import CollectionConfig, IndexType, Quantization, SearchRequest


@pytest.fixture
def db(spark, tmp_path):
    return Db.open(spark, str(tmp_path / "db"))


def vectors(n=200):
    return [(f"e{i}", [(1 + 0.01 * i if j == i % 16 else 0.25 if j == (i + 1) % 16 else 0.0) for j in range(16)], {"i": i}) for i in range(n)]


def test_catalog(db):
    db.create_collection("b", 3), db.create_collection("a", 3)
    assert db.list_collections() == ["a", "b"] and db.collection_exists("a") and not db.collection_exists("c")
    with pytest.raises(CollectionAlreadyExists):
        db.create_collection("a", 3)
    with pytest.raises(CollectionNotFound):
        db.collection("c")
    db.drop_collection("a")
    assert db.list_collections() == ["b"] and db.open_or_create("b", 3).config.dimension == 3
    for name, dim in (("x y", 3), ("x", 0), ("x", 70000)):
        with pytest.raises(InvalidQuery):
            CollectionConfig(name, dim)


def test_round_trip(db, tmp_path):
    c = db.create_collection_with(CollectionConfig("docs", 16))
    assert c.is_empty() and c.insert_batch(vectors()) == 200 and len(c) == 200
    for i in range(0, 200, 67):
        assert c.query(vectors()[i][1], 1).first()["id"] == f"e{i}"
    assert c.upsert_record("e0", [1.0] * 16, {"new": 1}, "machine learning") == "updated"
    assert c.insert("z", [2.0] * 16) == "inserted"
    assert json.loads(c.get("e0")["payload"]) == {"new": 1}
    c.delete("e1")
    for gone in ("e1", "nobody"):
        with pytest.raises(NotFound):
            c.delete(gone)
    assert len(c) == 200
    again = db.collection("docs")
    before = sorted(map(str, again.records().collect()))
    again.compact()
    assert again.files.names("log") == [] and sorted(map(str, again.records().collect())) == before
    again.insert_text("t", [0.5] * 16, {}, "machine vision")
    again.compact()
    assert {r["id"] for r in db.collection("docs").query_text("machine").collect()} == {"e0", "t"}
    assert db.collection("docs").stats()["vector_count"] == 201
    assert again.query_hybrid([0.5] * 16, "vision", 3).count() == 3
    assert db.sql("SELECT * FROM docs WHERE VECTOR_SIM(vector, [" + ", ".join(["1.0"] * 16) + "]) > -2 AND new = 1").first()["id"] == "e0"
    assert "VectorScan" in again.explain("SELECT * FROM docs WHERE VECTOR_SIM(vector, [" + ", ".join(["1.0"] * 16) + "]) > 0")
    found = again.execute_search(SearchRequest("docs", vector=tuple([0.5] * 16), query_text="vision", k=3))
    assert found.count() == 3 and found.columns == ["id", "score", "dense_score", "sparse_score", "payload", "text"]
    (tmp_path / "db/docs/log/batch=99").mkdir(parents=True)
    again.insert("late", [0.1] * 16)
    assert again.recover() == 1 and len(again) == 202 and "batch=99" not in again.files.names("log")
    with pytest.raises(DimensionMismatch):
        c.insert("bad", [1.0])
    with pytest.raises(DimensionMismatch):
        c.query([1.0])


@pytest.mark.parametrize("config", [{"quantization": Quantization.SCALAR_INT8}, {"quantization": Quantization.BINARY}, {"index_type": IndexType.IVF}])
def test_indexes(db, spark, config):
    c = db.create_collection_with(CollectionConfig("i", 16, **config))
    x = np.random.default_rng(0).standard_normal((300, 16))
    c.insert_frame(spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id STRING, vector ARRAY<FLOAT>"))
    live = [r["id"] for r in c.query(x[3].tolist(), 5).collect()]
    c.rebuild_index()
    assert c._indexed()
    indexed = [r["id"] for r in c.query(x[3].tolist(), 5).collect()]
    assert indexed[0] == live[0] == "v3" and (indexed == live or config.get("index_type"))
    c.insert("new", x[3].tolist())
    assert not c._indexed() and len(c.query(x[3].tolist(), 5).collect()) == 5


def test_jsonl(spark, tmp_path, db):
    p = tmp_path / "r.jsonl"
    p.write_text('{"id":"a","vector":[0.1,0.2,0.3],"payload":{"k":{"n":1}}}\n\nnot json\n{"id":"b"}\n{"id":"c","vector":[1,2,3],"text":"hi"}\n')
    good, bad = files.read_jsonl(spark, str(p))
    rows = {r["id"]: r for r in good.collect()}
    assert set(rows) == {"a", "c"} and bad.count() == 2
    assert json.loads(rows["a"]["payload"]) == {"k": {"n": 1}} and rows["c"]["payload"] == "{}"
    c = db.create_collection("c", 3)
    assert files.ingest(spark, str(p), c, dry_run=True) == {"read": 2, "skipped": 2, "written": 0} and c.is_empty()
    assert files.ingest(spark, str(p), c)["written"] == 2 and len(c) == 2
    with pytest.raises(Exception, match="bad line"):
        files.read_jsonl(spark, str(p), strict=True)[0].collect()


def test_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('id,vector,text\ndoc1,"[0.1,0.2,0.3]","hello, ""world"""\ndoc2,oops,x\n')
    good, bad = files.read_csv(spark, str(p))
    assert [r["text"] for r in good.collect()] == ['hello, "world"'] and bad.count() == 1
    p.write_text("id,text\na,b\n")
    with pytest.raises(SerializationError):
        files.read_csv(spark, str(p))


def test_vecs(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((50, 5)).astype("<f4")
    raw = np.concatenate([np.full((50, 1), 5, "<u4").view("<f4"), x], axis=1)
    (tmp_path / "a.fvecs").write_bytes(raw.tobytes())
    got = files.read_vecs(spark, str(tmp_path / "a.fvecs"), 5).orderBy("i").collect()
    assert np.array_equal(np.array([r["vector"] for r in got], np.float32), x)
    (tmp_path / "a.ivecs").write_bytes(np.array([[2, 7, 8], [2, 9, 1]], "<u4").tobytes())
    assert [r["vector"] for r in files.read_vecs(spark, str(tmp_path / "a.ivecs"), 2, "i").orderBy("i").collect()] == [[7, 8], [9, 1]]


def test_synthetic(spark):
    a, b = files.synthetic(spark, 20, 8).collect(), files.synthetic(spark, 20, 8).repartition(3).collect()
    assert {r["id"]: r["vector"] for r in a} == {r["id"]: r["vector"] for r in b}
    assert np.allclose(np.linalg.norm([r["vector"] for r in a], axis=1), 1, atol=1e-6)


def test_hoisted_fields_are_pushed_down(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f'{{"year": {i}}}') for i in range(10)], "id STRING, payload STRING")
    files.write_records(df, str(tmp_path / "h"), ("year",))
    back = spark.read.parquet(str(tmp_path / "h")).where("n_year > 7")
    assert back.count() == 2 and "GreaterThan(n_year" in back._jdf.queryExecution().toString()


def test_streams(spark, db, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", [1.0, 0.0], "{}", "x", 0, 100), ("a", [1.0, 0.0], "{}", "x", 0, 100), ("b", [0.0, 1.0], "{}", None, 1, 3700)]
    ops = spark.createDataFrame(rows, "id STRING, vector ARRAY<FLOAT>, payload STRING, text STRING, deleted INT, s BIGINT")
    ops.select("id", "vector", "payload", "text", F.timestamp_seconds("s").alias("created_at"), F.timestamp_seconds("s").alias("updated_at"), "deleted").write.parquet(src)
    once = ingest.deduplicated(ingest.read_operations(spark, src))
    counts = ingest.activity(ingest.read_operations(spark, src)).writeStream.format("memory").queryName("acts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {(r["upserts"], r["deletes"]) for r in spark.table("acts").collect()} == {(2, 0), (0, 1)}
    c = db.create_collection("s", 2)
    q = c.write_stream(once.drop("deleted"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"] for r in c.records().collect()} == {"a", "b"}


def test_order_beyond_128_partitions(spark, db):
    c = db.create_collection("wide", 2)
    rows = spark.range(0, 300, 1, 300).select(F.lit("a").alias("id"), F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("vector"))
    assert c.insert_frame(rows) == 300
    assert c.get("a")["vector"] == [299.0, 0.0]


def test_repeated_micro_batch(spark, db):
    c = db.create_collection("streamed", 2)
    kept = {}

    class Writer:
        def foreachBatch(self, f):
            kept["f"] = f
            return self

        def option(self, *_):
            return self

    class Stream:
        writeStream = Writer()

    c.write_stream(Stream(), "here")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id STRING, vector ARRAY<FLOAT>")
    kept["f"](rows, 0)
    c.delete("a")
    kept["f"](rows, 0)
    assert [r["id"] for r in c.records().collect()] == ["b"]
    c.compact()
    kept["f"](rows, 0)
    kept["f"](rows.where("id = 'a'"), 1)
    assert sorted(r["id"] for r in c.records().collect()) == ["a", "b"]


def test_indexed_fields_reach_the_scan(spark, db):
    c = db.create_collection_with(CollectionConfig("fields", 2, indexed_fields=("topic", "meta.rev")))
    rows = [(f"r{i}", [1.0, float(i)], '{"topic": "%s", "meta": {"rev": %d}}' % ("ab"[i % 2], i)) for i in range(20)] + [("s", [1.0, 0.0], '{"topic": 3, "meta": {"rev": "7"}}'), ("t", [1.0, 0.0], "{")]
    c.insert_frame(spark.createDataFrame(rows, "id STRING, vector ARRAY<FLOAT>, payload STRING"))
    filters = [{"topic": "a"}, {"topic": "3"}, {"topic": 3}, {"meta.rev": 7}, {"meta.rev": "7"}, [{"field": "meta.rev", "op": ">=", "value": "5"}, {"topic": "b"}], {"field": "topic", "op": "!=", "value": "a"}, {"topic": None}]
    before = [sorted(r["id"] for r in c.query_filtered([1.0, 0.0], 50, f).collect()) for f in filters]
    c.compact()
    assert before == [sorted(r["id"] for r in c.query_filtered([1.0, 0.0], 50, f).collect()) for f in filters]
    plan = c.query_filtered([1.0, 0.0], 50, {"topic": "a"})._jdf.queryExecution().toString()
    assert "EqualTo(f_topic,a)" in plan.rsplit("PushedFilters", 1)[1].split("ReadSchema")[0]
