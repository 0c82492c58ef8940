import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import aq_knn, components, density_peaks as dp, near_duplicates as nd
from brindle.llm.live import live_records, usable


def frame(spark, rows, schema="id STRING, collection_name STRING, vector ARRAY<FLOAT>"):
    return spark.createDataFrame(rows, schema)


def clusters(rng, sizes, dim=64, noise=0.8):
    means = np.linalg.qr(rng.standard_normal((dim, len(sizes))))[0].T
    x, label = [], []
    for k, n in enumerate(sizes):
        e = rng.standard_normal((n, dim)) / dim**0.5
        x.append(means[k] + noise * e), label.extend([k] * n)
    return np.concatenate(x) * rng.uniform(0.1, 9, (sum(sizes), 1)), np.array(label)


def test_live_records(spark):
    rows = [("a", 1, 0, "old"), ("a", 2, 0, "new"), ("a", 2, 0, "new"), ("b", 1, 0, "x"), ("b", 3, 1, "x"), ("c", None, 0, "n"), ("c", 1, 0, "y"), (None, 1, 0, "z"), ("d", 5, None, "w"), ("e", 1, 0, "p"), ("e", 1, 1, "q")]
    df = spark.createDataFrame(rows, "id STRING, t BIGINT, deleted INT, text STRING").withColumn("updated_at", F.timestamp_seconds("t")).withColumn("r", F.lit(1))
    assert {tuple(r) for r in live_records(df, ["text"]).collect()} == {("a", "new"), ("c", "y")}
    assert live_records(df.limit(0), ["text"]).count() == 0


def test_usable(spark):
    vs = [[1.0] * 64, None, [], [1.0] * 63, [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [0.0] * 63 + [2.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i INT, v ARRAY<FLOAT>")
    assert [r["i"] for r in df.where(usable("v")).collect()] == [0, 7]


@pytest.mark.parametrize("block_rows", [2048, 150])
def test_density_peaks(spark, block_rows):
    rng = np.random.default_rng(2)
    x, label = clusters(rng, [400, 200, 100, 60])
    stray = rng.standard_normal((40, 64))
    copies = np.repeat(rng.standard_normal((1, 64)), 30, axis=0)
    rows = [(f"r{i:04d}", "c", v.tolist()) for i, v in enumerate(np.concatenate([x, stray, copies]))] + [("null", "c", None), ("zero", "c", [0.0] * 64)]
    got = {r["id"]: r["cluster_id"] for r in dp.density_peaks(frame(spark, rows).withColumn("label", F.lit(1)), block_rows=block_rows).collect()}
    assert len(got) == 830
    names = [{got[f"r{i:04d}"] for i in np.nonzero(label == k)[0]} for k in range(4)]
    assert all(len(n) == 1 for n in names) and len(set().union(*names)) == 4 and None not in set().union(*names)
    assert all(got[f"r{i:04d}"] is None for i in range(760, 800))


@pytest.mark.parametrize("block_rows", [2048, 150])
def test_near_copies_are_a_cluster(spark, block_rows):
    rng = np.random.default_rng(16)
    x, _ = clusters(rng, [300, 200])
    near = rng.standard_normal(64) + 0.05 * rng.standard_normal((250, 64))
    same = np.repeat(rng.standard_normal((1, 64)), 30, axis=0)
    rows = [(f"r{i:04d}", "c", v.tolist()) for i, v in enumerate(np.concatenate([x, near, same]))]
    got = {r["id"]: r["cluster_id"] for r in dp.density_peaks(frame(spark, rows), block_rows=block_rows).collect()}
    names = [{got[f"r{i:04d}"] for i in range(a, b)} for a, b in ((0, 300), (300, 500), (500, 750), (750, 780))]
    assert all(len(n) == 1 for n in names) and len(set().union(*names)) == 4 and None not in set().union(*names)


def test_clusters_of_a_small_share(spark):
    x, _ = clusters(np.random.default_rng(17), [400, 300, 40, 8, 3], noise=0.6)
    df = frame(spark, [(f"r{i:04d}", "c", v.tolist()) for i, v in enumerate(x)])
    got = {r["id"]: r["cluster_id"] for r in dp.density_peaks(df, min_share=0.1, block_rows=200).collect()}
    names = [{got[f"r{i:04d}"] for i in range(a, b)} for a, b in ((0, 400), (400, 700), (700, 740), (740, 748), (748, 751))]
    assert len(got) == 751 and all(len(n) == 1 for n in names) and len(set().union(*names)) == 5 and None not in set().union(*names)


def test_clusters_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(18)
    x, _ = clusters(rng, [260, 120, 40, 6, 2], noise=0.95)
    rows = [(f"r{i:04d}", "c", v.tolist()) for i, v in enumerate(np.concatenate([x, rng.standard_normal((60, 64)), np.repeat(x[:1], 5, axis=0)]))]
    got = [{tuple(r) for r in dp.density_peaks(frame(spark, rows), block_rows=b).select("id", "cluster_id", F.round("similarity", 9)).collect()} for b in (2048, 90)]
    assert len(got[0]) == 493 and got[0] == got[1]


def test_density_and_denser_against_brute_force():
    rng = np.random.default_rng(19)
    x = np.concatenate([clusters(rng, [900, 300, 100])[0], rng.standard_normal((40, 64))])
    x = np.concatenate([x, x[:30]])
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    whole = np.rint(u * dp.SCALE).astype(np.float64)
    s, n, cut = whole @ whole.T / dp.SCALE**2, len(u), 700
    near = (s >= 0.45) & (s < 0.9)
    parts = [(u[:cut], u[cut:]), (u[cut:], u[:cut]), (u[:cut], u[:cut]), (u[cut:], u[cut:])]
    (d1, t1), (d2, t2), (d3, t3), (d4, t4) = [dp.densities(a, b, 0.45, 0.9) for a, b in parts]
    density = np.r_[d1 + d3, d2 + d4]
    assert np.array_equal(density, np.where(near, np.floor(s * dp.STEPS), 0).sum(axis=1))
    total = np.r_[t1 + t3, t2 + t4]
    assert np.array_equal(total, near.astype(np.float64) @ np.rint(u * dp.FINE).astype(np.float64))
    around = total + u * dp.FINE
    around = (around / np.linalg.norm(around, axis=1, keepdims=True)).astype(np.float32)
    agree = around.astype(np.float64) @ around.T.astype(np.float64) >= 0.7
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), -density))] = np.arange(n)
    best, to = dp.denser(u, u, True, rank, 0.55, around, 0.7)
    for i in range(n):
        allowed = [j for j in np.nonzero((rank < rank[i]) & (s[i] >= 0.55) & agree[i])[0]]
        j = min(allowed, key=lambda j: (-s[i, j], rank[j]), default=None)
        assert to[i] == (-1 if j is None else rank[j]) and best[i] == (-1 if j is None else s[i, j] * dp.SCALE**2)


def test_confirmed_clusters_are_not_compared_in_pairs(spark, monkeypatch):
    """Only a sample and what is in no confirmed cluster are compared all with all; a cluster that the sample misses is found."""
    rng = np.random.default_rng(20)
    x, _ = clusters(rng, [1200, 900, 600, 12, 5], noise=0.6)
    rows = [(f"r{i:04d}", "c", v.tolist()) for i, v in enumerate(np.concatenate([x, rng.standard_normal((100, 64))]))]
    compared, pointers = [], dp._pointers
    monkeypatch.setattr(dp, "_pointers", lambda df, n, *args: compared.append(n) or pointers(df, n, *args))

    def found(**kwargs):
        compared.clear()
        got = {r["id"]: r["cluster_id"] for r in dp.density_peaks(frame(spark, rows), block_rows=150, **kwargs).collect()}
        return got, sum(n * n for n in compared)

    whole, _ = found()
    assert compared.count(100) == 1  # what is in no cluster is compared once
    names = [{whole[f"r{i:04d}"] for i in range(a, b)} for a, b in ((0, 1200), (1200, 2100), (2100, 2700), (2700, 2712), (2712, 2717))]
    assert all(len(n) == 1 for n in names) and len(set().union(*names)) == 5 and None not in set().union(*names)
    for some in (300, 700):
        got, pairs = found(sample_rows=some)
        assert got == whole and pairs < 2817**2 / 4


def test_clusters_that_records_leave_open_are_compared_in_pairs(spark, monkeypatch):
    """Records lie about the limit of every cluster, so none is confirmed, and the sample decides nothing."""
    rng = np.random.default_rng(21)
    x, _ = clusters(rng, [500, 400], noise=1.4)
    df = frame(spark, [(f"r{i:04d}", "c", v.tolist()) for i, v in enumerate(x)])
    compared, pointers = [], dp._pointers
    monkeypatch.setattr(dp, "_pointers", lambda df, n, *args: compared.append(n) or pointers(df, n, *args))
    got = [{tuple(r) for r in dp.density_peaks(df, sample_rows=some).select("id", "cluster_id", F.round("similarity", 9)).collect()} for some in (200, 16_384)]
    assert compared.count(900) == 3 and len(got[0]) == 900 and got[0] == got[1]


def test_neighbours_of_few_are_added():
    rng = np.random.default_rng(22)
    x = rng.standard_normal((1500, 64))
    x[1000:] = x[:500] + 0.8 * rng.standard_normal((500, 64))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    whole = np.rint(u * dp.SCALE).astype(np.float64)
    s = whole @ whole.T / dp.SCALE**2
    near = (s >= 0.45) & (s < 0.9)
    d, total = dp.densities(u, u, 0.45, 0.9)
    assert np.array_equal(d, np.where(near, np.floor(s * dp.STEPS), 0).sum(axis=1))
    assert np.array_equal(total, near.astype(np.float64) @ np.rint(u * dp.FINE).astype(np.float64))


def test_density_peaks_of_little(spark):
    none = dp.density_peaks(frame(spark, []))
    assert none.count() == 0 and dp.describe_clusters(none).count() == 0
    one = dp.density_peaks(frame(spark, [("a", "c", [1.0] * 64)])).collect()
    assert [(r["id"], r["cluster_id"]) for r in one] == [("a", None)]


def test_clusters_described(spark):
    c = spark.createDataFrame([("a", "p", 0.9), ("b", "p", 0.9), ("c", "p", 0.8), ("d", None, None), ("e", "q", 0.7)], "id STRING, cluster_id STRING, similarity DOUBLE")
    assert {(r["cluster_id"], r["size"], r["rank"], r["id"]) for r in dp.describe_clusters(c, 2).collect()} == {("p", 3, 1, "a"), ("p", 3, 2, "b"), ("q", 1, 1, "e")}
    p = spark.createDataFrame([(1, "b", "a"), (2, "a", "b"), (3, "a", "e"), (4, "a", "a"), (5, "d", "d"), (6, None, "a")], "pair_id INT, id_a STRING, id_b STRING")
    assert [tuple(r) for r in dp.same_cluster(p, c).collect()] == [("a", "b")]


def brute(x, ids, groups, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(ids)):
        mine = [j for j in range(len(ids)) if groups[j] == groups[i] and j != i]
        out[ids[i]] = sorted(mine, key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]
    return s, out


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(3)
    x, _ = clusters(rng, [300, 200, 100])
    near = x[:60] * rng.uniform(1, 2, (60, 1)) + 0.02 * rng.standard_normal((60, 64)) * np.linalg.norm(x[:60], axis=1, keepdims=True)
    same = np.repeat(x[70:71], 9, axis=0)
    x = np.concatenate([x, near, same]).astype(np.float32).astype(np.float64)
    ids = [f"r{i:04d}" for i in range(len(x))]
    groups = ["a" if i % 60 % 3 else "b" for i in range(len(x))]
    return x, ids, groups


@pytest.mark.parametrize("block_rows", [4096, 100])
def test_pairs_of_nearest(spark, some, block_rows):
    x, ids, groups = some
    rows = [(i, g, v.tolist()) for i, g, v in zip(ids, groups, x)] + [("n", "a", None), ("g", None, [1.0] * 64)]
    s, best = brute(x, ids, groups, 5)
    true = {tuple(sorted((i, ids[j]))) for n, i in enumerate(ids) for j in best[i] if s[n, j] >= 0.9}
    got = aq_knn.nearest(frame(spark, rows).withColumn("norm", F.lit(1)), k=5, min_similarity=0.9, block_rows=block_rows)
    assert {tuple(r) for r in aq_knn.similar_pairs(got, 0.9).collect()} == true


def test_recall_against_brute_force(spark, some):
    x, ids, groups = some
    df = frame(spark, [(i, g, v.tolist()) for i, g, v in zip(ids, groups, x)])
    asked = spark.createDataFrame([(i,) for i in ids[::7]], "id STRING")
    got = aq_knn.nearest(df, k=5, probes=None, queries=asked).collect()
    s, best = brute(x, ids, groups, 5)
    found = {}
    for r in got:
        found.setdefault(r["id"], set()).add(r["neighbour"])
    assert set(found) == set(ids[::7])
    assert np.mean([len(found[i] & {ids[j] for j in best[i]}) / 5 for i in found]) >= 0.9
    assert all(abs(r["similarity"] - s[ids.index(r["id"]), ids.index(r["neighbour"])]) < 1e-5 for r in got)


def test_nearest_of_little(spark):
    assert aq_knn.nearest(frame(spark, [])).count() == 0
    two = aq_knn.nearest(frame(spark, [("a", "c", [1.0] * 64), ("b", "c", [2.0] * 64), ("c", "d", [1.0] * 64)])).collect()
    assert {(r["id"], r["neighbour"]) for r in two} == {("a", "b"), ("b", "a")}


def test_additive_codes():
    x = np.random.default_rng(0).standard_normal((2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = aq_knn.Quantiser(aq_knn.train_codebooks(x, [64] * 6))
    narrow, wide = ((c, n, np.stack([q.words[s + c[:, m]] for m, s in enumerate(q.starts)]).sum(axis=0)) for c, n in (q.encode(x, 1), q.encode(x, 8)))
    error = [((x - y) ** 2).sum(axis=1).mean() for _, _, y in (narrow, wide)]
    assert error[1] < error[0] < 0.7
    codes, norm, y = wide
    assert np.allclose(norm, (y * y).sum(axis=1), atol=1e-4)
    assert np.allclose(q.scores(x[:5], codes, norm), 2 * x[:5] @ y.T - norm, atol=1e-4)


def test_components(spark):
    rng = np.random.default_rng(5)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7), (8, None), (3, 4), (4, 3), (3, 4)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in e:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(e, "u BIGINT, v BIGINT")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(a, find(a)) for a in parent} and len(got) == len(parent)
    assert components.connected_components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def words(rng, n):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, 5000, n))


def truth(texts, width, least):
    sets = {i: {tuple(t.lower().split()[j : j + width]) for j in range(len(t.split()) - width + 1)} for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    return {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}


def test_near_duplicates(spark):
    rng = np.random.default_rng(6)
    texts = {}
    for g in range(12):
        base = words(rng, 40).split()
        for v in range(4):
            t = list(base)
            for k in rng.integers(0, 40, v):
                t[k] = f"x{g}{v}{k}"
            texts[f"t{g:02d}{v}"] = " ".join(t)
    texts |= {f"u{i}": words(rng, 30) for i in range(40)} | {"s1": "one two", "s2": "one two", "e1": "..!", "e2": "..!"}
    texts |= {f"c{i:03d}": "The SAME   words, here and there; again." if i % 2 else "the same words here and there again" for i in range(30)}
    clean = {i: t.replace("...", "").replace(",", "").replace(";", "").replace(".", "") for i, t in texts.items()}
    rows = [(i, t, None) for i, t in texts.items()]
    v = rng.standard_normal((6, 64))
    rows += [(f"v{i}", [None, " \t", ""][i % 3], (v[i // 2] * (1 + i) + 0.002 * rng.standard_normal(64)).tolist()) for i in range(6)]
    rows += [("w1", "a text of its own with enough words", v[0].tolist()), ("n1", None, None), ("n2", None, None), ("z1", None, [0.0] * 64), ("z2", None, [0.0] * 64), (None, "the same words here and there again", None)]
    df = spark.createDataFrame(rows, "id STRING, text STRING, vector ARRAY<FLOAT>").withColumn("rep", F.lit("x")).withColumn("uid", F.lit(1))
    groups = nd.near_duplicate_groups(df, width=3, text_similarity=0.6).cache()
    expected = truth(clean, 3, 0.6) | {("v0", "v1"), ("v2", "v3"), ("v4", "v5")}
    assert {tuple(r) for r in nd.group_pairs(groups, 100).collect()} == expected
    few = {tuple(r) for r in nd.group_pairs(groups, 5).collect()}
    assert few < expected and {("c000", f"c{i:03d}") for i in range(1, 30)} <= few


def test_hot_bands_are_compared_in_blocks(spark):
    rng = np.random.default_rng(8)
    base = words(rng, 60).split()
    texts = {}
    for i in range(150):
        t = list(base)
        t[int(rng.integers(0, 60))] = f"y{i}"
        texts[f"h{i:03d}"] = " ".join(t)
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts.values())], "uid BIGINT, words STRING")
    keys = df.select(F.lit(5).cast("bigint").alias("key"), "uid")
    same = lambda a, b: np.nonzero(np.ones((len(a), len(b)), bool))
    got = nd.candidate_pairs(keys, df, same, most=20, block_rows=40).collect()
    assert len(got) == 150 * 149 // 2 and all(r["a"] < r["b"] for r in got)
    links = nd.text_links(df, 5, 0.8, 20, 5).count()
    sets = [{tuple(t.split()[j : j + 5]) for j in range(56)} for t in texts.values()]
    assert links == sum(len(a & b) >= 0.8 * len(a | b) for n, a in enumerate(sets) for b in sets[n + 1 :])


def test_one_template_needs_few_links(spark):
    rng = np.random.default_rng(19)
    base, other = words(rng, 60).split(), words(rng, 60).split()
    texts = []
    for i in range(400):
        t = list(base if i % 10 else other)
        for k in rng.integers(0, 60, 1 if i % 4 else 5):
            t[int(k)] = f"y{i}{k}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "uid BIGINT, words STRING")
    few, every = (nd.text_links(df, 3, 0.6, 40, 3, s).distinct().cache() for s in (True, False))
    groups = [{(r["node"], r["component"]) for r in components.connected_components(x.select(F.col("a").alias("u"), F.col("b").alias("v"))).collect()} for x in (few, every)]
    assert groups[0] == groups[1] and few.count() < every.count() / 3
    # A key that brings unlike texts together: nothing is lost among those that aren't like the first.
    keys = df.select(F.lit(5).cast("bigint").alias("key"), "uid")
    alike = lambda x, y: np.nonzero((np.array(x["uid"])[:, None] % 7) == (np.array(y["uid"])[None] % 7))
    got = nd.spanning_links(keys, df, alike, lambda p: p.where("a % 7 = b % 7"), most=20, block_rows=40)
    c = components.connected_components(got.select(F.col("a").alias("u"), F.col("b").alias("v"))).collect()
    assert len(c) == 400 and all(r["component"] == r["node"] % 7 for r in c)


@pytest.mark.parametrize("bands,bits", [(1, 1), (4, 1), (3, 2)])
def test_rows_linked_to_different_hubs_are_connected(spark, bands, bits):
    """Neighbours along an arc: all rows of a band are connected, few of them to the same one."""
    e = np.linalg.qr(np.random.default_rng(31).standard_normal((64, 2)))[0].T
    angle = np.linspace(0, np.pi / 2, 400)
    v = np.cos(angle)[:, None] * e[0] + np.sin(angle)[:, None] * e[1]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "uid BIGINT, v ARRAY<FLOAT>")

    def parts(spanning):
        links = nd.vector_links(df, 0.98, bands, bits, spanning=spanning)
        return {r["node"]: r["component"] for r in components.connected_components(links.toDF("u", "v")).collect()}

    assert parts(True) == parts(False)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id STRING, text STRING, vector ARRAY<FLOAT>")
    assert nd.group_pairs(nd.near_duplicate_groups(df)).count() == 0
    long = spark.createDataFrame([("a", "w " * 100_000, None), ("b", "w " * 100_000 + "v", None)], "id STRING, text STRING, vector ARRAY<FLOAT>")
    assert nd.near_duplicate_groups(long, width=3, text_similarity=0.3).count() == 2


def exact(x, k):
    """Cosines in double of the single-precision vectors, and each one's k nearest others."""
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize(["least", "block_rows"], [(0.9, 4096), (0.9, 100), (None, 4096)])
def test_nearest_among_near_copies(spark, least, block_rows):
    rng = np.random.default_rng(12)
    x, _ = clusters(rng, [400, 300, 300])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + 0.2 * rng.standard_normal((334, 64)) / 8
    ids = [f"r{i:04d}" for i in range(1000)]
    s, best = exact(x, 5)
    got = {(r["id"], r["neighbour"]) for r in aq_knn.nearest(frame(spark, [(i, "c", v.tolist()) for i, v in zip(ids, x)]), 5, min_similarity=least, block_rows=block_rows).collect()}
    assert got == {(ids[i], ids[j]) for i in range(1000) for j in best[i] if least is None or s[i, j] >= least}


def test_recall_in_a_large_group(spark):
    rng = np.random.default_rng(13)
    x, _ = clusters(rng, [700] * 5)
    ids = [f"r{i:04d}" for i in range(3500)]
    _, best = exact(x, 5)
    asked = spark.createDataFrame([(i,) for i in ids[::20]], "id STRING")
    got = {(r["id"], r["neighbour"]) for r in aq_knn.nearest(frame(spark, [(i, "c", v.tolist()) for i, v in zip(ids, x)]), 5, probes=None, queries=asked).collect()}
    assert got == {(ids[i], ids[j]) for i in range(0, 3500, 20) for j in best[i]}


def test_recall_of_divided_groups(spark):
    rng = np.random.default_rng(18)
    x, _ = clusters(rng, [900] * 4)
    ids = [f"r{i:04d}" for i in range(3600)]
    s, best = exact(x, 5)
    df = frame(spark, [(i, "c" if int(i[1:]) < 3000 else "d", v.tolist()) for i, v in zip(ids, x)])
    asked = spark.createDataFrame([(i,) for i in ids[::20]], "id STRING")
    found = aq_knn.nearest(df, 5, queries=asked, block_rows=500, asked_rows=60).cache()
    assert found.groupBy("id").count().where("count = 5").count() == 180
    r = aq_knn.recall(found, df, asked, 5).first()
    assert r["asked"] == 180 and r["expected"] == 900 and r["hit"] >= 0.9 * 900


def test_rows_sent_do_not_grow_with_the_cells(spark):
    """Parts, pieces of a part and queries from other parts give the pairs of brute force; no row is sent to every cell."""
    rng = np.random.default_rng(33)
    x, _ = clusters(rng, [500] * 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::5] = x[1::5] + 0.3 * rng.standard_normal((400, 64)) / 8
    x[:300] = x[0] + 0.3 * rng.standard_normal((300, 64)) / 8
    ids = [f"r{i:04d}" for i in range(2000)]
    s, best = exact(x, 5)
    df = frame(spark, [(i, "c", v.tolist()) for i, v in zip(ids, x)])
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() > before)

    before = -1
    for cells in (256, 16):
        stages = store.stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        before = max((stages.apply(i).stageId() for i in range(stages.size())), default=-1)
        got = {(r["id"], r["neighbour"]) for r in aq_knn.nearest(df, 5, min_similarity=0.9, block_rows=50, cells=cells).collect()}
        assert got == {(ids[i], ids[j]) for i in range(2000) for j in best[i] if s[i, j] >= 0.9}
        assert written() < 15 * 2000


def test_cells_that_are_left_out_hold_nothing_similar():
    x, _ = clusters(np.random.default_rng(14), [300] * 6)
    x = np.concatenate([x, x[:200] + 0.3 * np.random.default_rng(15).standard_normal((200, 64)) * np.linalg.norm(x[:200], axis=1, keepdims=True) / 8])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cells, count = aq_knn.Cells(x, 32).met(x, 0.9)
    start = np.r_[0, np.cumsum(count)]
    met = [set(cells[a:b].tolist()) for a, b in zip(start, start[1:])]
    assert all(cells[start[j]] in met[i] for i, j in zip(*np.nonzero(x @ x.T >= 0.9))) and count.mean() < 20
