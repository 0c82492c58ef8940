import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.errors import DimensionMismatch, InvalidQuery
from brindle.functions import vector as V
from brindle.operators import evals, ivf, knn, quantize
from brindle.types import Metric


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def frame(spark, x, **more):
    rows = [(f"v{i:05d}", [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id STRING, vector ARRAY<FLOAT>")


@pytest.fixture(scope="module")
def some(spark):
    x = np.random.default_rng(1).standard_normal((600, 8)).astype(np.float32)
    return x, frame(spark, x).cache()


def test_kernels(spark):
    assert one(spark, V.euclidean([0, 0], [3, 4])) == 5
    assert one(spark, V.cosine([1, 2], [1, 2])) == pytest.approx(1)
    assert one(spark, V.cosine([1, 0], [0, 1])) == 0
    assert one(spark, V.cosine([1, 0], [-1, 0])) == -1
    assert one(spark, V.cosine([0, 0], [1, 0])) == 0
    assert one(spark, V.normalize([3, 4])) == [0.6, 0.8]
    assert one(spark, V.normalize([0, 0])) == [0, 0]
    assert one(spark, V.similarity([1, 2], [3, 4], "dot")) == 11
    assert one(spark, V.similarity([0, 0], [3, 4], "euclidean")) == pytest.approx(1 / 6)
    V.register_sql_functions(spark)
    assert spark.sql("SELECT vector_sim(array(1D, 0D), array(1D, 1D)), vec_l2(array(0D), array(2D))").first() == (pytest.approx(0.5**0.5), 2.0)


@pytest.mark.parametrize("metric", list(Metric))
def test_dense_search_is_exact(spark, some, metric):
    x, df = some
    q = x[7].astype(float)
    got = [r["id"] for r in knn.dense_search(df, q, 10, metric).collect()]
    s = knn._scores(q[None], x.astype(float), metric)[0]
    assert got == [f"v{i:05d}" for i in np.argsort(-s, kind="stable")[:10]]
    batch = knn.batch_knn(df.where("id = 'v00007'").select(F.col("id").alias("query_id"), "vector"), df, 10, metric)
    assert [r["id"] for r in batch.orderBy("rank").collect()] == got


def test_batch_knn_in_blocks(spark, some):
    x, df = some
    df = df.withColumn("kind", F.pmod(F.xxhash64("id"), F.lit(3)).cast("string"))
    q = df.select(F.col("id").alias("query_id"), "vector", "kind")
    rows = lambda d: sorted(map(str, d.withColumn("score", F.round("score", 6)).collect()))
    for group in (None, "kind"):
        sent = knn.batch_knn(q, df, 4, "euclidean", group=group)
        blocks = knn.batch_knn(q, df, 4, "euclidean", group=group, sent_queries=10, block_rows=40)
        assert rows(sent) == rows(blocks) and sent.count() == 2400
    assert knn.batch_knn(q.limit(0), df, 4).count() == 0 and knn.batch_knn(q, df.limit(0), 4).count() == 0


def test_dense_search_edges(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 5.0), ("b", [1.0, 0.0], 6.0), ("c", None, 1.0), ("d", [1.0], 1.0), ("e", [float("nan"), 1.0], 1.0)], "id STRING, vector ARRAY<FLOAT>, score DOUBLE")
    assert [r["id"] for r in knn.dense_search(df, [1, 0], 10).collect()] == ["a", "b", "e"]
    assert knn.dense_search(df.limit(0), [1, 0], 3).count() == 0
    with pytest.raises(DimensionMismatch):
        knn.checked([1.0], 2)
    with pytest.raises(InvalidQuery):
        knn.top(df, -1)


def test_filter_runs_before_top_k(spark):
    x = [[(7 * i + 13 * j) % 97 + 0.01 * i for j in range(12)] for i in range(1000)]
    df = frame(spark, x).withColumn("payload", F.format_string('{"bucket": %d}', F.substring("id", 2, 9).cast("int") % 20))
    for i, bucket in ((500, 3), (321, 7)):
        got = {r["id"] for r in knn.dense_search(df, x[i], 10, "euclidean", {"bucket": bucket}).collect()}
        of = [j for j in range(1000) if j % 20 == bucket]
        true = sorted(of, key=lambda j: (sum((a - b) ** 2 for a, b in zip(x[i], x[j])), j))[:10]
        assert got == {f"v{j:05d}" for j in true}
    assert knn.dense_search(df, x[0], 10, "euclidean", {"bucket": 999}).count() == 0


def test_int8(spark, some):
    x, df = some
    fitted = quantize.Int8.fit(df, "euclidean")
    back = fitted.build(df).select(fitted.decode("codes").alias("v")).collect()
    assert np.abs(np.array([r["v"] for r in back]) - x).max() <= max(fitted.dscale) / 2 + 1e-6
    exact = {r["id"] for r in knn.dense_search(df, x[3].astype(float), 10, "euclidean").collect()}
    assert len(exact & {r["id"] for r in quantize.int8_search(df, x[3].astype(float), 10, "euclidean").collect()}) >= 9
    for metric in Metric:
        f = quantize.Int8.fit(df, metric)
        built = f.build(df)
        got = f.search(built, x[3].astype(float), 600).select("id", "score").collect()
        decoded = {r["id"]: r["v"] for r in built.select("id", f.decode("codes").alias("v")).collect()}
        q = x[3].astype(float) / (np.linalg.norm(x[3]) if metric is Metric.COSINE else 1)
        for r in got[:20]:
            assert r["score"] == pytest.approx(knn._scores(q[None], np.array([decoded[r["id"]]]), metric)[0, 0], abs=1e-6)
    assert quantize.Int8.code_bytes(10, 4) == 40 + 40 + 32


def test_binary(spark):
    rows = [(f"a{i}", [10.0] * 4 + [0.0] * 4) for i in range(150)] + [(f"b{i}", [0.0] * 4 + [10.0] * 4) for i in range(150)]
    df = spark.createDataFrame(rows, "id STRING, vector ARRAY<FLOAT>")
    got = quantize.binary_search(df, [9.0] * 4 + [1.0] * 4, 10).collect()
    assert all(r["id"].startswith("a") and r["score"] == 1 for r in got)
    b = quantize.Binary((0.0,) * 70)
    wide = [1.0] * 64 + [-1.0] * 5 + [1.0]
    assert b.encode_literal(wide) == [-1, 32] == one(spark, b.encode([*wide]))


def test_ivf(spark, some):
    x, df = some
    index = ivf.IvfIndex.train(df, "euclidean", lists=16)
    assigned = index.assign(df).cache()
    exact = [r["id"] for r in knn.dense_search(df, x[5].astype(float), 10, "euclidean").collect()]
    assert [r["id"] for r in index.search(assigned, x[5].astype(float), 10, lists=16).collect()] == exact
    assert index.search(assigned, x[5].astype(float), 1, lists=1).first()["id"] == "v00005"


def test_ivf_saved(spark, some, tmp_path):
    x, df = some
    index = ivf.IvfIndex.train(df, "cosine", lists=8)
    index.save(index.assign(df), str(tmp_path / "ivf"))
    again, rows = ivf.IvfIndex.load(spark, str(tmp_path / "ivf"))
    assert again.probe(x[0], 3) == index.probe(x[0], 3)
    found = again.search(rows, x[0].astype(float), 5, 2)
    assert found.first()["id"] == "v00000"
    assert "PartitionFilters: [cid" in found._jdf.queryExecution().toString()


def test_ivf_changes(spark, some):
    x, df = some
    index = ivf.IvfIndex.train(df, "euclidean", lists=8)
    moved = frame(spark, [x[0] + 100, x[1]]).union(spark.createDataFrame([("new", x[2].tolist())], "id STRING, vector ARRAY<FLOAT>"))
    changed = index.insert(index.assign(df), moved).cache()
    assert changed.count() == 601 and index.search(changed, (x[0] + 100).astype(float), 1).first()["id"] == "v00000"
    less = index.delete(changed, spark.createDataFrame([("new",), ("nobody",)], "id STRING"))
    assert less.count() == 600
    again, rows = index.rebuilt(less, lists=4)
    assert len(again.centroids) == 4 and rows.count() == 600


def test_ivf_of_nothing(spark, some):
    _, df = some
    index = ivf.IvfIndex.train(df.limit(0))
    assert index.search(df, [0.0] * 8, 3).count() == 3


def test_evals(spark):
    f = spark.createDataFrame([(1, "a"), (1, "b"), (1, "d")], "query_id INT, id STRING")
    t = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "query_id INT, id STRING")
    assert evals.recall_at_k(f, t, 3).first()[0] == pytest.approx(2 / 3)
    v = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    for p in (0, 37, 50, 95, 99, 100):
        floor, near = int(99 * p / 100) + 1, int(99 * p / 100 + 0.5) + 1
        assert v.agg(evals.percentile_floor("v", p)).first()[0] == floor == evals.exact_percentile(v, "v", p).first()[0]
        assert v.agg(evals.percentile_round("v", p)).first()[0] == near == evals.exact_percentile(v, "v", p, "round").first()[0]
    assert evals.exact_percentile(v.limit(0), "v", 50).count() == 0
    g = spark.createDataFrame([(k, float(i % 7)) for i in range(500) for k in ("a", "b")] + [("c", 4.0), ("d", None)], "k STRING, v DOUBLE")
    assert {tuple(r) for r in evals.exact_percentile(g, "v", 50, by="k").collect()} == {("a", 3.0), ("b", 3.0), ("c", 4.0)}
    assert evals.timed(lambda: None, 10)["qps"] > 0
