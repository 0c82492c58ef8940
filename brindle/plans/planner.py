"""Plans of searches: the nodes, their cost, a text form, and the DataFrame that carries them out."""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from brindle.errors import InvalidQuery
from brindle.functions.filters import Bool, Field, Similar, compile_filter
from brindle.operators.bm25 import Bm25Index
from brindle.operators.fusion import hybrid_search
from brindle.operators.knn import checked, score_column, top
from brindle.plans import dialect
from brindle.types import CollectionConfig, Fusion, SearchRequest


@dataclass
class Node:
    """VectorScan, SparseScan, HybridScan, Filter, Join, Project, Sort or Limit, with what it is given."""

    kind: str
    args: dict = field(default_factory=dict)
    input: "Node | None" = None

    def text(self, indent: int = 2) -> str:
        args = ", ".join(f"{k}={_shown(v)}" if k else _shown(v) for k, v in self.args.items())
        return "  " * indent + f"{self.kind}({args})\n" + (self.input.text(indent + 1) if self.input else "")


def _shown(v) -> str:
    return f"{v:.2f}" if isinstance(v, float) else str(v)


def cost(n: int, k: int) -> float:
    return math.log(n) * k * 0.1 if n > 0 else 0.0


def uses_ann(n: int) -> bool:
    return n >= 100


def pre_filters(selectivity: float, n: int) -> bool:
    return selectivity < 0.1 or n > 100_000


def candidate_k(k: int, hybrid: bool, filtered: bool) -> int:
    """k times 10, 5, 3 or 1; at most 10,000, at least k."""
    factor = 10 if hybrid and filtered else 5 if hybrid else 3 if filtered else 1
    return max(min(k * factor, 10_000), k)


@dataclass
class Plan:
    root: Node
    config: CollectionConfig
    hybrid: bool
    pre_filter: bool
    candidates: int
    k: int
    cost: float
    request: SearchRequest
    strategy: Fusion = Fusion()
    threshold: tuple[str, float] | None = None
    order_by: str | None = None
    descending: bool = False
    order_all: bool = False

    def explain(self) -> str:
        f = self.request.filter
        return (
            f"PhysicalPlan {{\n  index_type: {self.config.index_type.value}\n  use_hybrid: {str(self.hybrid).lower()}\n  pre_filter: {str(self.pre_filter).lower()}\n"
            f"  candidate_k: {self.candidates}\n  output_k: {self.k}\n  estimated_cost: {self.cost:.2f}\n  filter: {'None' if f is None else _filter_text(f)}\n"
            f"  logical_tree:\n{self.root.text()}}}\n"
        )


def _filter_text(f) -> str:
    return repr(f) if isinstance(f, (Bool, Similar)) else json.dumps(f, default=repr)


def plan_search(config: CollectionConfig, request: SearchRequest, n: int, strategy: Fusion = Fusion()) -> Plan:
    """Plan for a request over ``n`` records. A filter always runs before the scan's top-k."""
    if request.vector is None and not request.query_text:
        raise InvalidQuery("a vector or a text is needed")
    hybrid = request.vector is not None and bool(request.query_text)
    filtered = request.filter is not None
    many = candidate_k(request.k, hybrid, filtered)
    if hybrid:
        node = Node("HybridScan", {"k": many, "alpha": float(request.alpha), "strategy": "RRF" if strategy.kind == "rrf" else "WeightedSum"})
    elif request.vector is not None:
        node = Node("VectorScan", {"k": many, "alpha": float(request.alpha)})
    else:
        node = Node("SparseScan", {"k": many})
    if filtered:
        node = Node("Filter", {"": _filter_text(request.filter)}, node)
    node = Node("Limit", {"": request.k}, Node("Sort", {"": "score desc"}, node))
    return Plan(node, config, hybrid, filtered and pre_filters(0.05, n), many, request.k, cost(n, request.k), request, strategy)


def plan_sql(config: CollectionConfig, sql: str, n: int, strict: bool = True, order_all: bool = False) -> Plan:
    c = dialect.convert(dialect.parse(sql), strict)
    checked(c.vector, config.dimension)
    request = SearchRequest(c.table, c.vector, None, c.k, filter=c.filter, columns=tuple(c.columns))
    plan = plan_search(config, request, n)
    plan.threshold, plan.order_by, plan.descending, plan.order_all = c.threshold, c.order_by, c.descending, order_all
    if c.columns:
        plan.root = Node("Project", {"": f"[{', '.join(c.columns)}]"}, plan.root)
    return plan


_COMPARE: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def execute(plan: Plan, records: DataFrame, index: Bm25Index | None = None) -> DataFrame:
    """``id, score, dense_score, sparse_score, payload, text`` of the plan's results.

    Filter and threshold stand before the top-k. With ORDER BY, the k best by score are put in the order of the field, or,
    if the plan is to ``order_all``, all that match are, of which the first k are returned.
    """
    r, c = plan.request, plan.config
    none = F.lit(None).cast("double")

    def similar(s: Similar):
        return (F.size("vector") == len(s.vector)) & _COMPARE[s.op](score_column(s.vector, c.metric), F.lit(s.threshold))

    kept = records if r.filter is None else records.where(compile_filter(r.filter, similar=similar))
    by_field = bool(plan.order_by) and plan.order_by not in ("score", "similarity")
    if plan.hybrid:
        found = hybrid_search(kept, r.vector, r.query_text, plan.candidates, r.alpha, plan.strategy, c.metric, index)
    elif r.vector is not None:
        q = checked(r.vector, c.dimension)
        scored = kept.where(F.size("vector") == len(q)).withColumn("score", score_column(q, c.metric))
        if plan.threshold:
            scored = scored.where(_COMPARE[plan.threshold[0]](F.col("score"), F.lit(plan.threshold[1])))
        found = scored.withColumn("dense_score", F.col("score")).withColumn("sparse_score", none)
    else:
        index = index or Bm25Index.build(records, k1=c.bm25_k1, b=c.bm25_b)
        scores = index.search(r.query_text, plan.candidates, kept.select("id") if r.filter is not None else None)
        found = scores.join(kept, "id").withColumn("sparse_score", F.col("score")).withColumn("dense_score", none)
    out = found.select("id", "score", "dense_score", "sparse_score", "payload", "text")
    keys = [F.desc("score"), "id"] if not plan.order_by or plan.descending else ["score", "id"]
    if by_field:
        f = Field(plan.order_by.removeprefix("payload."), "payload", "id")
        out = out.withColumn("_n", f.number).withColumn("_t", f.text)
        keys = ["_n", "_t", "id"] if not plan.descending else [F.col("_n").desc_nulls_last(), F.col("_t").desc_nulls_last(), "id"]
    out = out.orderBy(*keys).limit(plan.k) if by_field and plan.order_all else top(out, plan.k)
    return project(out.orderBy(*keys).drop("_n", "_t"), list(r.columns))


def project(results: DataFrame, columns: list[str]) -> DataFrame:
    """Only the listed top-level keys of the payload, and the text only if listed; no columns or ``*``: everything."""
    if not columns or "*" in columns:
        return results
    keys = [c for c in columns if c not in ("id", "score", "similarity", "text")]
    fields = F.map_from_entries(
        F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.try_variant_get(F.try_parse_json("payload"), f"$['{k}']", "variant").alias("v")) for k in keys]), lambda e: e["v"].isNotNull())
    ) if keys else None
    is_object = F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")
    shown = F.to_json(fields) if fields is not None else F.lit("{}")
    results = results.withColumn("payload", F.when(is_object, shown).otherwise(F.col("payload")))
    return results if "text" in columns else results.withColumn("text", F.lit(None).cast("string"))


def join_payload(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join of results with another collection's rows on payload fields; right columns get the prefix ``r_``."""
    def key(df: DataFrame, name: str) -> DataFrame:
        f = Field(name, "payload", "id")
        return df.withColumn("_key", F.coalesce(f.text, f.json))

    r = key(right, right_key)
    return key(left, left_key).join(r.select("_key", *[F.col(c).alias(f"r_{c}") for c in right.columns]), "_key").drop("_key")
