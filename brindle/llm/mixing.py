"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which that vocabulary's tokenizer divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(documents: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``documents`` with the number of tokens of each text instead of it, in ``tokens``; NULL and empty texts have none.

    The vocabulary file is read once by each task. A column of the name ``tokens`` is replaced.
    """
    keep = [c for c in documents.columns if c not in (text, "tokens")]
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields if f.name in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return documents.select(*keep, text).mapInArrow(count, f"{rest}, tokens BIGINT")


def _source_name(column: str):
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def water_fill(tokens: dict[str, int], share: dict[str, float], repeats: dict[str, int], clamped: dict[str, int] | None = None) -> dict[str, float]:
    """Tokens of each source in a mixture as large as all sources: what exceeds a source's ``tokens * repeats`` goes to the
    others in proportion to their shares, again and again, until none exceeds. If all sources are at their limit the
    mixture is smaller. ``clamped`` is filled with the round, from 1 on, in which a source was set to its limit."""
    total, most = sum(tokens.values()), {s: tokens[s] * repeats[s] for s in tokens}
    given: dict[str, float] = {}
    clamped = {} if clamped is None else clamped
    open_ = {s for s in tokens if share[s] > 0}
    while open_:
        left, weight = total - sum(given.values()), math.fsum(share[s] for s in open_)
        over = {s for s in open_ if share[s] / weight * left > most[s]}
        if not over:
            given |= {s: share[s] / weight * left for s in open_}
            break
        given |= {s: float(most[s]) for s in over}
        clamped |= dict.fromkeys(over, max(clamped.values(), default=0) + 1)
        open_ -= over
    return {s: given.get(s, 0.0) for s in tokens}


def plan_mixture(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, documents, tokens, reachable, epochs, planned_share``: one row for each listed
    source.

    Sources are compared trimmed and in lower case; every row of ``sized`` (``source, tokens``) counts, other sources
    don't. ``reachable`` is false if the first round of filling clamps the source: even ``max_repeats`` times it is less than
    its share of a mixture as large as all listed sources; ``epochs`` is how often the source goes into the mixture. A NULL share is 0, a NULL ``max_repeats``
    1, a negative one 0; a source listed twice has the sum of its shares and the larger ``max_repeats``. Only one row a
    listed source reaches the driver.
    """
    name = _source_name("source")
    listed = (
        targets.where("source IS NOT NULL").groupBy(name.alias("source"))
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )
    totals = sized.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    rows = listed.join(totals, "source", "left").na.fill(0, ["documents", "tokens"]).orderBy("source").collect()
    tokens, share, repeats = ({r["source"]: r[c] for r in rows} for c in ("tokens", "target_share", "max_repeats"))
    clamped: dict[str, int] = {}
    filled = water_fill(tokens, share, repeats, clamped)
    mixed = sum(filled.values()) or 1.0
    plan = [
        (s, float(share[s]), int(repeats[s]), int(r["documents"]), int(tokens[s]), clamped.get(s) != 1, filled[s] / tokens[s] if tokens[s] else 0.0, filled[s] / mixed)
        for r in rows for s in [r["source"]]
    ]
    columns = "source STRING, target_share DOUBLE, max_repeats INT, documents BIGINT, tokens BIGINT, reachable BOOLEAN, epochs DOUBLE, planned_share DOUBLE"
    return sized.sparkSession.createDataFrame(plan, columns)


def repetitions(sized: DataFrame, plan: DataFrame, id_col: str = "doc_id", seed: int = 0, slots: int = 4096) -> DataFrame:
    """``doc_id, source, tokens, repeats``: how often each document of the listed sources stands in the mixture; those with 0
    are left out.

    All documents of a source get its whole epochs, and of the rest those whose seeded hash falls in the source's first
    slots, as many as are nearest to the missing tokens; a document stands in at most ``max_repeats`` times. Sums of tokens
    by source and slot decide, so no source is ordered or gathered anywhere.
    """
    docs = sized.select(F.col(id_col).alias("doc_id"), _source_name("source").alias("source"), "tokens")
    docs = docs.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(slots)))
    p = plan.select("source", F.floor("epochs").alias("whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("missing"))
    sums = docs.join(p, "source").groupBy("source", "slot", "missing").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("slot"))
    ends = sums.withColumn("upto", upto).where(F.col("upto") - F.col("t") / 2 <= F.col("missing")).groupBy("source").agg(F.max("slot").alias("last"))
    times = F.col("whole") + F.when((F.col("missing") > 0) & (F.col("slot") <= F.col("last")), 1).otherwise(0)
    return docs.join(p, "source").join(ends, "source", "left").select("doc_id", "source", "tokens", times.cast("int").alias("repeats")).where("repeats > 0")


def mixture_shares(repeated: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, target_share, planned_share, actual_share, documents, mixed_tokens`` of the mixture."""
    by = repeated.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    rows = plan.select("source", "target_share", "planned_share").join(by, "source", "left").na.fill(0, ["documents", "mixed_tokens"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # of one row a listed source
    share = F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0)
    return rows.select("source", "target_share", "planned_share", share.alias("actual_share"), "documents", "mixed_tokens")
