import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import fm_spans as fm, leakage, leximin as lex, mixing, parsimonious as plm

# Terms


POSTINGS = "collection_name STRING, id STRING, term STRING, term_frequency FLOAT, raw_count BIGINT, idf FLOAT"


def postings(rng, records=60):
    out = []
    for i in range(records):
        c = "x" if i % 3 else "y"
        terms = {"the": rng.randint(2, 6), "of": rng.randint(1, 3)} | {f"w{rng.randint(0, 60)}": rng.randint(1, 4) for _ in range(rng.randint(0, 8))}
        dl = sum(terms.values())
        out += [(c, f"r{i}", t, n / dl, n, 1.0) for t, n in terms.items()]
    return out


def test_outstanding_terms(spark):
    rows = postings(random.Random(1))
    extra = rows[:20] + [("x", "dead", "zzz", 1.0, 5, None), ("x", "r1", None, 0.1, 1, 1.0), ("x", None, "a", 0.1, 1, 1.0), ("x", "r1", "nul", None, None, 1.0), ("x", "r2", "neg", 0.1, -1, 1.0)]
    df = spark.createDataFrame(rows + extra, POSTINGS).withColumn("n", F.lit("n")).withColumn("df", F.lit(1))
    live = df.select("id", "collection_name").where("id != 'dead'").distinct()
    d = plm.distinct_postings(df, live).cache()
    terms = plm.characteristic_terms(d).cache()
    of, dfs = defaultdict(dict), Counter()
    for c, i, t, _, n, _ in rows:
        of[c, i][t] = n
    for (c, _), ts in of.items():
        dfs.update((c, t) for t in ts)
    n = Counter(c for c, _ in of)
    expected, share = set(), {}
    for (c, i), ts in of.items():
        w = sorted(((k / sum(ts.values()) * math.log((n[c] - dfs[c, t] + 0.5) / (dfs[c, t] + 0.5) + 1), t) for t, k in ts.items()), reverse=True)
        if len(w) > 1 and w[0][0] >= 1.7 * w[1][0]:
            expected.add((i, w[0][1]))
    assert {tuple(r) for r in plm.outstanding_terms(terms).collect()} == expected and expected
    # Against a plain expectation-maximisation.
    total = Counter()
    for (c, _), ts in of.items():
        for t, k in ts.items():
            total[c, t] += k
            total[c] += k
    got = {(r["id"], r["term"]): r["probability"] for r in terms.collect()}
    for (c, i), ts in list(of.items())[:10]:
        p = {t: k / sum(ts.values()) for t, k in ts.items()}
        for _ in range(400):
            e = {t: k * 0.1 * p[t] / (0.9 * total[c, t] / total[c] + 0.1 * p[t]) for t, k in ts.items()}
            p = {t: v / sum(e.values()) for t, v in e.items()}
        for t in ts:
            assert got.get((i, t), 0) == pytest.approx(p[t], abs=0.02)


def test_lengths_replace_missing_counts(spark):
    df = spark.createDataFrame([("c", "a", "t", 0.25, None, None), ("c", "a", "u", 0.5, 4, None), ("c", "a", "v", None, None, None)], POSTINGS)
    lengths = spark.createDataFrame([("c", "a", 8), ("c", "a", None), ("c", "b", 1)], "collection_name STRING, id STRING, doc_length BIGINT")
    assert {(r["term"], r["raw_count"]) for r in plm.distinct_postings(df, None, lengths).collect()} == {("t", 2), ("u", 4)}


def test_terms_of_nothing(spark):
    d = plm.distinct_postings(spark.createDataFrame([], POSTINGS), None)
    assert plm.outstanding_terms(plm.characteristic_terms(d)).count() == 0
    one = plm.characteristic_terms(spark.createDataFrame([("c", "a", "t", 3)], "collection_name STRING, id STRING, term STRING, raw_count BIGINT"))
    assert one.first()["rival"] is None and plm.outstanding_terms(one).count() == 0


# Ranking


def rank(vs):
    """Part of the others that are worse; None and NaN are worst."""
    key = [-math.inf if v is None or v != v else v for v in vs]
    bad = [v is None or v != v for v in vs]
    worse = lambda i, j: (bad[j], key[j]) != (bad[i], key[i]) and (bad[j] and not bad[i] or not bad[j] and not bad[i] and key[j] < key[i])
    return [sum(worse(i, j) for j in range(len(vs))) / max(1, len(vs) - 1) for i in range(len(vs))]


@pytest.mark.parametrize("large", [10**6, 5])
def test_leximin(spark, large):
    rng = random.Random(2)
    values = [None, float("nan"), 0.0, 1.0, 2.0, -5.0, float("-inf"), 1e9]
    rows = [(q, f"i{i:02d}", *[rng.choice(values) if rng.random() < 0.5 else rng.gauss(0, s) for s in (1, 100, 0.01)]) for q in range(4) for i in range([1, 9, 30, 60][q])]
    df = spark.createDataFrame(rows + [(None, "i", 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)], "g INT, i STRING, a DOUBLE, b DOUBLE, c DOUBLE").withColumn("place", F.lit(7))
    wanted = spark.createDataFrame([(0, 3), (1, 4), (2, 5), (3, 60), (9, 2)], "g INT, k INT")
    got = lex.first_places(lex.leximin(df, "g", "i", ["a", "b", "c"], large), wanted, "g", "i")
    expected = set()
    for q, k in ((0, 3), (1, 4), (2, 5), (3, 60)):
        mine = [r for r in rows if r[0] == q]
        levels = [sorted(x) for x in zip(*[rank([r[c] for r in mine]) for c in (2, 3, 4)])]
        order = sorted(range(len(mine)), key=lambda n: ([-round(x, 12) for x in levels[n]], mine[n][1]))
        expected |= {(q, mine[n][1], p + 1) for p, n in enumerate(order[:k])}
    assert {(r["g"], r["i"], r["place"]) for r in got.collect()} == expected


def test_latest(spark):
    rows = [(1, "a", 1, 0.1), (1, "a", 2, 0.2), (1, "a", 2, 0.2), (1, "a", None, 0.9), (None, "a", 1, 0.3), (2, None, 1, 0.1)]
    df = spark.createDataFrame(rows, "q INT, id STRING, t INT, s DOUBLE")
    assert [tuple(r) for r in lex.latest(df, ["q", "id"], "t", ["s"]).collect()] == [(1, "a", 0.2)]
    none = lex.first_places(lex.leximin(df.limit(0), "q", "id", ["s"]), spark.createDataFrame([], "q INT, k INT"), "q", "id")
    assert none.count() == 0


# Leaks


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "too short"), (103, "one " * 12), (104, "ab ba " * 8), (None, "x " * 20)]
    docs = []
    for d in range(300):
        w = [word() for _ in range(rng.randint(0, 400))]
        if d % 3 == 0:
            src = rng.choice(items[:60])[1].split()
            n = rng.randint(8, 14)
            a = rng.randint(0, max(0, len(src) - n))
            p = rng.randint(0, len(w))
            w[p:p] = [x.upper() if rng.random() < 0.5 else x for x in src[a : a + n]]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(900, None), (901, ""), (902, "one " * 10), (903, "one " * 9), (904, "BA-" + "ab_ba " * 9), (905, "z " * 30_000 + items[0][1])]
    expected = set()
    runs = defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for j in range(len(w) - 9):
            if i is not None:
                runs[tuple(w[j : j + 10])].add(i)
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for j in range(len(w) - 9):
            expected |= {(d, i) for i in runs.get(tuple(w[j : j + 10]), ())}
    df, ev = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id BIGINT, passage STRING")
    got = leakage.leaked_items(df, ev).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected) > 40
    parts = leakage.leaked_items(df, ev, index_bytes=0).collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, got))
    assert leakage.leaked_items(df.limit(0), ev, index_bytes=0).count() == 0
    assert leakage.leaked_items(df.limit(0), ev).count() == 0 and leakage.leaked_items(df, ev.limit(0)).count() == 0
    whole = [r for r in got if r["doc_id"] == 905 and r["item_id"] == 0]
    assert not whole or whole[0]["share"] == 1


def test_bands():
    for s in (0.2, 0.5, 0.75, 0.95):
        b, r = leakage.choose_bands(s, 1e-6, 64)
        assert (1 - s**r) ** b <= 1e-6


# Mixing


def test_water_filling():
    tokens, share = {"a": 100, "b": 100, "c": 800}, {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.water_fill(tokens, share, {"a": 2, "b": 1, "c": 1})
    assert got == pytest.approx({"a": 200, "b": 100, "c": 700})
    assert mixing.water_fill(tokens, share, {"a": 1, "b": 1, "c": 0}) == pytest.approx({"a": 100, "b": 100, "c": 0})
    assert mixing.water_fill({"a": 0}, {"a": 1.0}, {"a": 1}) == {"a": 0}
    rounds = {}
    mixing.water_fill({"a": 100, "b": 250, "c": 650}, {"a": 0.5, "b": 0.24, "c": 0.26}, {"a": 1, "b": 1, "c": 9}, rounds)
    assert rounds == {"a": 1, "b": 2}


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", " A\t", "b", "c", "other", None]), rng.randint(0, 50)) for i in range(4000)]
    sized = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, tokens BIGINT")
    targets = spark.createDataFrame([("a", 0.2, 2), ("B", 0.7, 2), ("c", 0.05, None), ("gone", 0.05, 3), (None, 0.1, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    plan = mixing.plan_mixture(sized, targets)
    rows = {r["source"]: r for r in plan.collect()}
    assert set(rows) == {"a", "b", "c", "gone"}
    by = Counter()
    for _, s, t in docs:
        by[(s or "").strip().lower()] += t
    total = by["a"] + by["b"] + by["c"]
    assert {s for s, r in rows.items() if not r["reachable"]} == {s for s, w, k in (("a", 0.2, 2), ("b", 0.7, 2), ("c", 0.05, 1), ("gone", 0.05, 3)) if by[s] * k < w * total}
    times = mixing.repetitions(sized, plan).collect()
    mixed = Counter()
    for r in times:
        assert 1 <= r["repeats"] <= {"a": 2, "b": 2, "c": 1}[r["source"]]
        mixed[r["source"]] += r["repeats"] * r["tokens"]
    for s in "abc":
        assert mixed[s] == pytest.approx(rows[s]["epochs"] * by[s], rel=0.01)
    assert sorted(map(str, times)) == sorted(map(str, mixing.repetitions(sized.repartition(7), plan).collect()))
    shares = {r["source"]: r["actual_share"] for r in mixing.mixture_shares(mixing.repetitions(sized, plan), plan).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["gone"] == 0
    empty = mixing.plan_mixture(sized.limit(0), targets)
    assert mixing.repetitions(sized.limit(0), empty).count() == 0 and mixing.plan_mixture(sized, targets.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world, it's 2024"), (2, None), (3, ""), (4, "é\u0000 " * 20_000)], "doc_id BIGINT, text STRING").withColumn("tokens", F.lit("x"))
    got = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(df).collect()}
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(mixing.TOKENIZER.replace(".tiktoken", ".json"))
    assert got[2] == got[3] == 0 and all(got[i] == len(other.encode(t, add_special_tokens=False).ids) for i, t in ((1, "Hello world, it's 2024"), (4, "é\u0000 " * 20_000)))


# Spans


def test_fm_index():
    rng = np.random.default_rng(7)
    seq = rng.integers(2, 6, 3000).astype(np.uint32)
    seq[2000:2400] = seq[100:500]
    seq[0] = seq[-1] = fm.SEPARATOR
    index = fm.FMIndex(seq, 64)
    text = seq.tobytes()
    ends = np.arange(64, 2999, 13)
    at, lo, hi = index.search(seq, ends, 40, 1)
    assert len(at) == len(ends)
    for a, x, y in list(zip(at, lo, hi))[::5]:
        p = seq[ends[a] - 40 : ends[a]].tobytes()
        true = [i for i in range(3000 - 39) if text[4 * i : 4 * i + 160] == p]
        assert sorted(index.sa[x:y].tolist()) == true
    for c in range(5):
        bwt = np.unique(seq, return_inverse=True)[1][index.sa - 1]
        for i in (0, 1, 64, 65, 2999, 3000):
            assert index.rank(np.array([c]), np.array([i]))[0] == (bwt[:i] == c).sum()


def spans(docs, n):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            where[t[i : i + n]].add(d)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    shared = {}
    for d, t in docs:
        m = np.zeros(len(t or "") + 1, bool)
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                m[i : i + n] = True
        shared[d] = int(m.sum())
    return pairs, shared


@pytest.mark.parametrize("options", [{}, {"hot": 3, "block_rows": 4, "shard_chars": 5000}])
def test_shared_spans(spark, options):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ßé😀") for _ in range(n))
    block, short = text(330), text(285)
    docs = [(i, text(rng.randint(0, 900))) for i in range(40)]
    docs += [(100 + i, text(rng.randint(0, 400)) + block[: rng.choice([299, 300, 310, 330])] + text(rng.randint(0, 300))) for i in range(12)]
    docs += [(200 + i, text(rng.randint(0, 50)) + short + text(200)) for i in range(15)]
    same = text(500)
    docs += [(300 + i, same) for i in range(4)] + [(310, "x" + same[:400])]
    twice = text(320)
    docs += [(400, twice + text(100) + twice), (500, None), (501, ""), (502, "a" * 3000), (503, "b" + "a" * 305), (504, "ab" * 900), (505, "ab" * 200)]
    pairs, shared = spans(docs, 300)
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumn("id", F.lit(1)).withColumn("anchor", F.lit(1))
    p, s, c = fm.shared_spans(df, **options)
    assert {tuple(r) for r in fm.shared_pairs(p, c).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in fm.shared_parts(df, s, c).collect()} == shared
    few = {tuple(r) for r in fm.shared_pairs(p, c, most=2).collect()}
    assert {(300, 301), (300, 302), (300, 303)} <= few <= pairs


def test_spans_of_nothing(spark):
    p, s, c = fm.shared_spans(spark.createDataFrame([], "doc_id BIGINT, text STRING"))
    assert fm.shared_pairs(p, c).count() == 0 and s.count() == 0


def test_portions():
    import pyarrow as pa

    from brindle.llm.live import portions

    b = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (5, 5, 100, 1, 1, 0)] + [None, "b"]})
    assert [p.num_rows for p in portions(b, "t", 3, 10)] == [2, 1, 3, 2]
    assert sum(([*p.column("t").to_pylist()] for p in portions(b.slice(1, 5), "t", 2, 10)), []) == b.slice(1, 5).column("t").to_pylist()


def test_every_term_has_a_weight(spark):
    rows = [("c", f"r{i}", t, n) for i in range(20) for t, n in (("the", 1), (f"w{i}", 40), *((f"x{i}{j}", 2) for j in range(6)))]
    got = plm.characteristic_terms(spark.createDataFrame(rows, "collection_name STRING, id STRING, term STRING, raw_count BIGINT")).collect()
    assert {(r["id"], r["term"]) for r in got} == {r[1:3] for r in rows} and len(got) == len(rows)
    assert all(sorted(r["place"] for r in got if r["id"] == f"r{i}") == list(range(1, 9)) for i in range(20))


def test_terms_of_live_records(spark, data):
    from brindle.llm import queries

    assert queries.p4_terms(spark, data).count() == queries._terms(spark, data).count() > 0
    assert queries.p4_terms(spark, data).where("place > 5").count() > 0


def test_stretches_make_up_what_is_shared(spark, data):
    from brindle.llm import queries

    sums = {}
    for r in queries.p8_spans(spark, data).collect():
        assert 0 <= r["start"] < r["stop"]
        n, chars = sums.get(r["doc_id"], (0, 0))
        sums[r["doc_id"]] = (n + 1, chars + r["stop"] - r["start"])
    assert sums == {r["doc_id"]: (r["spans"], r["shared_chars"]) for r in queries.p8_shared(spark, data).where("spans > 0").collect()} and sums
