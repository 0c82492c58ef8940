import json

import pytest
from hypothesis import given, settings, strategies as st

from brindle.errors import InvalidQuery
from brindle.functions.filters import compile_filter, fields_of
from brindle.plans import dialect, planner
from brindle.types import CollectionConfig, SearchRequest

TRUTH = [
    ({"v": "5"}, {"field": "v", "op": "=", "value": 5}, True),
    ({"v": "5"}, {"field": "v", "op": "=", "value": "5.0"}, False),
    ({"v": 5}, {"field": "v", "op": "=", "value": "5.0"}, True),
    ({"v": True}, {"field": "v", "op": "=", "value": 1}, False),
    ({"v": True}, {"field": "v", "op": "=", "value": True}, True),
    ({"v": True}, {"field": "v", "op": "!=", "value": False}, True),
    ({"v": "abc"}, {"field": "v", "op": ">", "value": "abb"}, False),
    ({"v": "7"}, {"field": "v", "op": ">", "value": "6.5"}, True),
    ({}, {"field": "v", "op": "!=", "value": "x"}, False),
    ({"v": None}, {"field": "v", "op": "!=", "value": "x"}, True),
    ({"v": None}, {"field": "v", "op": "=", "value": None}, True),
    ({"v": "a_b"}, {"field": "v", "op": "LIKE", "value": "a_b"}, True),
    ({"v": "axb"}, {"field": "v", "op": "LIKE", "value": "a_b"}, False),
    ({"v": "Hello"}, {"field": "v", "op": "LIKE", "value": "hello%"}, False),
    ({"v": "Hello"}, {"field": "v", "op": "LIKE", "value": "%ell%"}, True),
    ({"v": 5}, {"field": "v", "op": "LIKE", "value": "5"}, False),
    ({"v": " 12 "}, {"field": "v", "op": "=", "value": 12}, False),
    ({"v": "1d"}, {"field": "v", "op": "=", "value": 1}, False),
    ({"v": "inf"}, {"field": "v", "op": ">", "value": 1e300}, True),
    ({"v": "nan"}, {"field": "v", "op": ">", "value": 0}, False),
    ({"a": {"b": 2}}, {"field": "a.b", "op": "<=", "value": 2}, True),
    ({"a": [1, 2]}, {"a": [1, 2]}, True),
    ({"a": [{"b": 1}]}, {"field": "a.b", "op": "=", "value": 1}, False),
    ({"v": 1}, {"field": "v", "op": "~", "value": 1}, False),
    ({"v": 1, "w": "x"}, {"v": 1, "w": "x"}, True),
    ({"v": 1, "w": "x"}, [{"v": 1}, {"w": "y"}], False),
    ({"v": {"$gte": 2000}}, {"v": {"$gte": 2000}}, True),
    ({"v": 2001}, {"v": {"$gte": 2000}}, False),
    ({"v": 1}, {}, True),
    ({"v": 1}, [], True),
    ({"v": 1}, "v", False),
    ({"v": 1}, {"field": "id", "op": "=", "value": "r"}, True),
]


def test_truth(spark):
    for payload, f, expected in TRUTH:
        df = spark.createDataFrame([("r", json.dumps(payload))], "id STRING, payload STRING")
        assert df.select(compile_filter(f)).first()[0] is expected, (payload, f)


def test_payloads_that_are_no_json(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", '{"v": 1'), ("d", "[1]"), ("e", '"v"')], "id STRING, payload STRING")
    for f in ({"v": 1}, {"field": "v", "op": "!=", "value": 1}, {"field": "v.w", "op": "<", "value": 1}):
        assert [r[0] for r in df.select(compile_filter(f)).collect()] == [False] * 5


def number(v):
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        try:
            return float(v) if v == v.strip() and "_" not in v else None
        except ValueError:
            return None
    return float(v)


def plain(v, op, w):
    same = v == w and isinstance(v, str) == isinstance(w, str)
    if not (isinstance(v, str) and isinstance(w, str)) and not (isinstance(v, bool) and isinstance(w, bool)):
        a, b = number(v), number(w)
        same = a == b if a is not None and b is not None else v is None and w is None
    if op in ("=", "!="):
        return same == (op == "=")
    a, b = number(v), number(w)
    return a is not None and b is not None and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


scalars = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from([0.5, -1.5, 2.0, "2", "2.0", "-1.5", "x", "", "1e1", " 2"]))


@settings(max_examples=12, deadline=None)
@given(st.lists(scalars, min_size=8, max_size=8), scalars, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]))
def test_as_plain_python(spark, values, w, op):
    df = spark.createDataFrame([(str(i), json.dumps({"v": v})) for i, v in enumerate(values)], "id STRING, payload STRING")
    got = [r[0] for r in df.select(compile_filter({"field": "v", "op": op, "value": w})).collect()]
    assert got == [plain(v, op, w) for v in values], (values, op, w)


def test_fields():
    assert fields_of([{"field": "a.b", "op": "=", "value": 1}, {"c": 2}]) == {"a.b", "c"}


def test_lexer():
    kinds = [(t.kind, t.value) for t in dialect.tokenize("select a->>'it''s' <> -1.5e3, [-2]")]
    assert kinds == [("keyword", "SELECT"), ("name", "a"), ("op", "->>"), ("string", "it's"), ("op", "!="), ("number", -1500.0), ("mark", ","), ("mark", "["), ("number", -2), ("mark", "]"), ("end", None)]
    with pytest.raises(InvalidQuery):
        dialect.tokenize("a # b")


def test_parser():
    s = dialect.parse("SELECT id, text FROM docs WHERE VECTOR_SIM(vector, [0.1, 1, -2.5]) > 0.5 AND (a.b = 'x' OR NOT c->'d' <= 3) ORDER BY year DESC LIMIT 7;")
    assert (s.columns, s.table, s.order_by, s.descending, s.limit) == (["id", "text"], "docs", "year", True, 7)
    c = dialect.convert(s)
    assert c.vector == (0.1, 1.0, -2.5) and c.k == 7 and c.threshold == (">", 0.5)
    assert dialect.convert(s, strict=False).filter is None
    for bad in ("SELECT FROM t", "SELECT * FROM t WHERE", "SELECT * FROM t LIMIT x", "SELECT * FROM t WHERE a = ", "UPDATE t"):
        with pytest.raises(InvalidQuery):
            dialect.parse(bad)
    with pytest.raises(InvalidQuery):
        dialect.convert(dialect.parse("SELECT * FROM t WHERE a = 1"))


CONFIG = CollectionConfig("t", 4)


def test_planner():
    assert [planner.candidate_k(10, *x) for x in ((True, True), (True, False), (False, True), (False, False))] == [100, 50, 30, 10]
    assert planner.candidate_k(5000, True, True) == 10_000 and planner.candidate_k(20_000, True, True) == 20_000
    assert planner.uses_ann(100) and not planner.uses_ann(99)
    assert planner.pre_filters(0.05, 10) and planner.pre_filters(0.5, 100_001) and not planner.pre_filters(0.5, 10)
    p = planner.plan_search(CONFIG, SearchRequest(vector=(1, 0, 0, 0), query_text="x", k=10, filter={"a": 1}), 1000)
    assert "HybridScan(k=100, alpha=0.70, strategy=WeightedSum)" in p.explain() and "Limit(10)" in p.explain() and "use_hybrid: true" in p.explain()
    with pytest.raises(InvalidQuery):
        planner.plan_search(CONFIG, SearchRequest(), 10)


@pytest.fixture(scope="module")
def ab(spark):
    rows = [(f"a{i}", [float(i), 1.0, 0.0, 0.0], json.dumps({"cat": "A", "n": i, "deep": {"k": "x"}}), f"text {i}") for i in range(5)]
    rows += [(f"b{i}", [float(i), 0.0, 1.0, 0.0], json.dumps({"cat": "B", "n": i}), None) for i in range(5)]
    return spark.createDataFrame(rows, "id STRING, vector ARRAY<FLOAT>, payload STRING, text STRING").cache()


def run(ab, sql, strict=True):
    return planner.execute(planner.plan_sql(CONFIG, sql, 10, strict), ab).collect()


def test_sql(ab):
    near = "VECTOR_SIM(vector, [0.0, 1.0, 0.0, 0.0])"
    assert {r["id"] for r in run(ab, f"SELECT * FROM t WHERE cat = 'A' AND {near} > -2")} == {f"a{i}" for i in range(5)}
    assert [r["id"] for r in run(ab, f"SELECT * FROM t WHERE {near} > 0.9")] == ["a0"]
    assert len(run(ab, f"SELECT * FROM t WHERE {near} > 0.9", strict=False)) == 10
    assert [r["id"] for r in run(ab, f"SELECT * FROM t WHERE {near} > -2 AND deep->>'k' = 'x' AND n >= 3 ORDER BY n DESC")] == ["a4", "a3"]
    assert run(ab, f"SELECT * FROM t WHERE {near} > -2 AND deep->>'k' = 'x'", strict=False) == []
    assert len(run(ab, f"SELECT * FROM t WHERE {near} > -2 AND (cat = 'B' OR n = 0)")) == 6
    r = run(ab, f"SELECT id, cat FROM t WHERE {near} > -2 LIMIT 1")[0]
    assert json.loads(r["payload"]) == {"cat": "A"} and r["text"] is None
    assert run(ab, f"SELECT text FROM t WHERE {near} > -2 LIMIT 1")[0]["text"] == "text 0"


def test_join_payload(ab):
    j = planner.join_payload(ab.where("id = 'a1'"), ab, "n", "n")
    assert {r["r_id"] for r in j.collect()} == {"a1", "b1"}
