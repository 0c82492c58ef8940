"""Long exact spans shared between records: compressed FM-indexes over shards, searched backwards.

Any common substring of ``span`` characters contains a common anchor: the ``gram``-character sequence whose hash is the
least among neighbouring ones. Stretches of text around anchors that several documents have go to shards by anchor, so a
document meets only those it may share a span with. A shard's stretches are indexed (suffix order, Burrows-Wheeler
transform, wavelet matrix), the same stretches stream by, and backward search from every ``step``-th place gives the
matching statistics there; windows that match elsewhere are extended to both sides and reported if long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brindle.llm.near_duplicates import _copies, _mix
from brindle.runtime import cut

SEPARATOR = 1


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` characters from each place on, by doubling."""
    h, k = _mix(c.astype(np.uint64) + np.uint64(77)), 1
    while 2 * k <= width:
        h = _mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]) if len(h) > k else h[:0]
        k *= 2
    rest = width - k
    return h if not rest else _mix(h[:-rest] * np.uint64(0xC2B2AE3D27D4EB4F) + h[rest:]) if len(h) > rest else h[:0]


def _slide(h: np.ndarray, width: int, f) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h, n = f(h[: len(h) - n], h[n:]), 2 * n
    return f(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def anchors(c: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the text's anchors: in every ``span`` characters there is at least one."""
    h, w = gram_hashes(c, gram), span - gram + 1
    if len(h) < w:
        return h[:0], np.zeros(0, np.int64)
    least = _slide(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.nonzero(_slide(np.r_[edge, least, edge], w, np.maximum) == h)[0]
    return _thinned(h[at], at, w - 1)


def _thinned(h: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Without those between two equal anchors at most ``reach`` apart, of which every window that holds them holds one;
    periodic text would have an anchor in every place."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    close = (h[1:] == h[:-1]) & (np.diff(at) <= reach)
    if not (close[1:] & close[:-1]).any():
        return h, at
    keep, last, places = np.ones(len(at), bool), int(at[0]), at.tolist()
    for i, c in enumerate(close.tolist(), 1):
        if c and i < len(close) and close[i] and places[i + 1] - last <= reach:
            keep[i] = False
        else:
            last = places[i]
    return h[keep], at[keep]


class FMIndex:
    """FM-index of a sequence of small integers that begins and ends with the least of them, which patterns don't hold. Its
    suffixes are ordered by their first ``depth`` places, which suffices for patterns of up to that length."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.n = n = len(seq)
        self.symbols, s = np.unique(seq, return_inverse=True)
        sigma = len(self.symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        pack = max(1, 63 // self.levels)
        rank, k = s.astype(np.int64), 1
        while k < min(pack, depth):
            take = min(k, pack - k)
            moved = np.zeros(n, np.int64)
            moved[: n - k] = rank[k:] if take == k else rank[k:] >> (self.levels * (k - take))
            rank = (rank << (self.levels * take)) | moved
            k += take
        self.sa, rank, distinct = self._order(rank)
        while k < depth and distinct < n:
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            self.sa, rank, distinct = self._order(rank * (n + 1) + nxt)
            k *= 2
        bwt = s[self.sa - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma))].astype(np.int64)
        # Wavelet matrix: a bit vector for each level, packed, with the number of ones before every word.
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]].astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    @staticmethod
    def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        order = np.argsort(key, kind="stable")
        k = key[order]
        number = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        rank = np.empty(len(key), np.int64)
        rank[order] = number
        return order, rank, int(number[-1]) + 1

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros)):
            ones = before[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i of the transform."""
        return self._descend(symbol, i) - self.base[symbol]

    def search(self, seq: np.ndarray, ends: np.ndarray, length: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``length`` places of ``seq`` before each end; those whose interval keeps at least ``least``
        suffixes, and their intervals."""
        s = np.searchsorted(self.symbols, seq)
        at, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for t in range(1, length + 1):
            c = s[ends[at] - t]
            both = self.rank(np.r_[c, c], np.r_[lo, hi])
            lo, hi = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            alive = hi - lo >= least
            if not alive.all():
                at, lo, hi = at[alive], lo[alive], hi[alive]
            if not len(at):
                break
        return at, lo, hi


def shared_in_shard(doc: np.ndarray, start: np.ndarray, text: list[str], span: int, step: int, with_pairs: bool = True, chunk: int = 200_000) -> tuple[set, list]:
    """Pairs of documents that share a span (if asked for), and the places of the spans: ``(doc_a, doc_b)``, ``(doc, start, end)``.

    doc, start, text: stretches of documents; of one document they may overlap."""
    order = np.lexsort((start, doc))
    merged: list[tuple[int, int, str]] = []
    for i in order.tolist():
        d, a, t = int(doc[i]), int(start[i]), text[i]
        if merged and merged[-1][0] == d and a <= merged[-1][1] + len(merged[-1][2]):
            _, b, u = merged[-1]
            merged[-1] = (d, b, u + t[max(0, b + len(u) - a) :])
        else:
            merged.append((d, a, t))
    where: dict[str, list[tuple[int, int]]] = {}
    for d, a, t in merged:
        if len(t) >= span:
            where.setdefault(t, []).append((d, a))
    pairs: set[tuple[int, int]] = set()
    spans: list[tuple[int, int, int]] = []
    stretches = list(where)
    for t in stretches:
        docs = sorted({d for d, _ in where[t]})
        if len(docs) > 1:
            if with_pairs:
                pairs.update((x, y) for n, x in enumerate(docs) for y in docs[n + 1 :])
            spans.extend((d, a, a + len(t)) for d, a in where[t])
    if len(stretches) < 2:
        return pairs, spans
    size = np.array([len(t) for t in stretches])
    begin = np.r_[0, np.cumsum(size + 1)[:-1]] + 1
    seq = np.full(size.sum() + len(size) + 1, SEPARATOR, np.uint32)
    for b, t in zip(begin, stretches):
        seq[b : b + len(t)] = codes(t) + 2
    owner = np.repeat(np.arange(len(size)), size + 1)
    owner = np.r_[0, owner]
    length = span - step + 1
    ends = np.concatenate([np.arange(b + length, b + n + 1, step) for b, n in zip(begin, size)])
    index = FMIndex(seq, length)
    at, lo, hi = index.search(seq, ends, length)
    padded = np.r_[np.full(step, SEPARATOR, np.uint32), seq, np.full(step, SEPARATOR, np.uint32)]
    reach = np.arange(step)
    found: set[int] = set()
    count = hi - lo
    total = np.r_[0, np.cumsum(count)]
    done = 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + chunk, "right")) - 1)
        n = count[done:upto]
        q = np.repeat(at[done:upto], n)
        sa = index.sa[np.repeat(lo[done:upto] - (total[done:upto] - total[done]), n) + np.arange(n.sum())]
        p = ends[q] - length
        other = p != sa
        p, sa = p[other], sa[other]
        # How far the match goes on to the left and to the right; a separator ends it.
        left_p, left_s = padded[p[:, None] + step - 1 - reach], padded[sa[:, None] + step - 1 - reach]
        right_p, right_s = padded[p[:, None] + step + length + reach], padded[sa[:, None] + step + length + reach]
        left = np.logical_and.accumulate((left_p == left_s) & (left_p != SEPARATOR), axis=1).sum(axis=1)
        right = np.logical_and.accumulate((right_p == right_s) & (right_p != SEPARATOR), axis=1).sum(axis=1)
        ok = left + right + length >= span
        p, sa, left, right = p[ok], sa[ok], left[ok], right[ok]
        i, j = owner[p], owner[sa]
        # A stretch repeating itself only counts where other documents have it too, which is seen from the other stretch.
        differs = i != j
        p, i, j, left, right = p[differs], i[differs], j[differs], left[differs], right[differs]
        found.update(np.unique(i * len(size) + j).tolist())
        for x, y, a, b in set(zip(i.tolist(), j.tolist(), (p - left - begin[i]).tolist(), (p + length + right - begin[i]).tolist())):
            for d, base in where[stretches[x]]:
                if any(other != d for other, _ in where[stretches[y]]):
                    spans.append((d, base + a, base + b))
        done = upto
    for both in found if with_pairs else ():
        for x, _ in where[stretches[both // len(size)]]:
            for y, _ in where[stretches[both % len(size)]]:
                if x != y:
                    pairs.add((min(x, y), max(x, y)))
    return pairs, spans


def _merge_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for d, a, b in sorted(spans):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1] = (d, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((d, a, b))
    return out


def shared_spans(
    documents: DataFrame,
    span: int = 300,
    gram: int = 200,
    refined: int = 270,
    step: int = 25,
    hot: int = 64,
    shard_chars: int = 1_000_000,
    block_rows: int = 2000,
    with_pairs: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What distinct texts share: pairs ``doc_a, doc_b`` of representatives with a common substring of at least ``span``
    characters; merged ``doc_id, start, stop`` of all such substrings in them; and ``id, rep`` of texts with copies.

    Characters are code points, compared exactly. Copies of a whole text are represented by the one of least doc_id.
    NULL texts, texts shorter than ``span`` and rows without doc_id share nothing. An anchor in more than ``hot`` documents
    is replaced by longer ones around it (``refined`` characters, at every place that a span through the anchor can begin,
    in steps), so that a common block shorter than that brings nothing together. A longer anchor that still has more than
    ``block_rows`` stretches is divided into blocks of which every two meet in a task of their own. Without ``with_pairs``
    there are no pairs, whose number grows with the square of the documents that have a block of text in common.
    """
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").where(F.length("text") >= span).select(F.col("doc_id").cast("bigint").alias("id"), "text")
    copies = cut(_copies(docs, "text"))
    reps = docs.join(copies.where("id != rep").select("id"), "id", "left_anti")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at, ids = [], [], []
            for d, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                x, y = anchors(codes(t), span, gram)
                h.append(x.view(np.int64)), at.append(y), ids.append(np.full(len(y), d, np.int64))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(h)), pa.array(np.concatenate(at).astype(np.int32))], names=["id", "anchor", "at"])

    all_anchors = cut(reps.mapInArrow(find, "id BIGINT, anchor BIGINT, at INT"))
    shared = all_anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b")
    mine = all_anchors.join(shared.select("anchor", (F.col("n") > hot).alias("hot")), "anchor")
    places = mine.groupBy("id").agg(F.collect_list(F.struct("at", "anchor", "hot")).alias("p"))  # bounded by the document's own length

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ids, begin, text = [], [], [], []
            for d, t, p in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("p").to_pylist()):
                longer = gram_hashes(codes(t), refined).view(np.int64) if any(x["hot"] for x in p) else None
                for x in p:
                    at = x["at"]
                    a = max(0, at - (span - gram))
                    keys = [x["anchor"]]
                    if x["hot"]:
                        starts = range(at, max(-1, at - (span - gram) - 1), -(span - refined))
                        keys = [int(longer[s]) for s in starts if 0 <= s < len(longer)]
                    for k in keys:
                        key.append(k), ids.append(d), begin.append(a), text.append(t[a : at + span])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(begin, pa.int32()), pa.array(text, pa.string())], names=["key", "id", "begin", "text"])

    stretches = cut(reps.join(places, "id").mapInArrow(stretch, "key BIGINT, id BIGINT, begin INT, text STRING"))
    keys = stretches.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).where("a != b")
    keys = cut(keys.select("key", "chars", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")))
    shards = max(1, -(-(keys.where("parts = 1").agg(F.sum("chars")).first()[0] or 0) // shard_chars))
    k = stretches.join(keys.select("key", "parts"), "key")
    small = k.where("parts = 1").select(F.pmod(F.xxhash64("key"), F.lit(int(shards))).alias("shard"), F.lit(-1).alias("x"), F.lit(-1).alias("y"), "id", "begin", "text")
    large = k.where("parts > 1").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select(F.col("key").alias("shard"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "id", "begin", "text")

    def meet(t: pa.Table) -> pa.Table:
        pairs, spans = shared_in_shard(np.asarray(t["id"]), np.asarray(t["begin"]), t["text"].to_pylist(), span, step, with_pairs)
        spans = _merge_spans(spans)
        rows = [(0, a, b, None) for a, b in pairs] + [(1, d, a, b) for d, a, b in spans]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["kind", "u", "v", "w"])

    met = cut(small.unionByName(large).groupBy("shard", "x", "y").applyInArrow(meet, "kind INT, u BIGINT, v BIGINT, w BIGINT"))
    pairs = met.where("kind = 0").select(F.col("u").alias("doc_a"), F.col("v").alias("doc_b")).distinct()
    # Spans of a document that overlap are one: a new one begins after the largest end so far.
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    pieces = met.where("kind = 1").select(F.col("u").alias("doc_id"), F.col("v").alias("start"), F.col("w").alias("stop"))
    ends = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = pieces.withColumn("first", F.coalesce(F.col("start") > ends, F.lit(True)).cast("int"))
    number = F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = first.withColumn("nth", number).groupBy("doc_id", "nth").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("nth")
    return pairs, spans, copies


def shared_pairs(pairs: DataFrame, copies: DataFrame, most: int = 20) -> DataFrame:
    """``doc_a, doc_b``: pairs of documents, the smaller first. Of a class of copies the first ``most`` by id are paired like
    their representative and with each other; further ones with the representative only."""
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    first = copies.withColumn("place", place).where(F.col("place") <= most).select("id", "rep")
    a, b = first.select(F.col("rep").alias("doc_a"), F.col("id").alias("x")), first.select(F.col("rep").alias("doc_b"), F.col("id").alias("y"))
    across = pairs.join(a, "doc_a", "left").join(b, "doc_b", "left").select(F.coalesce("x", "doc_a").alias("p"), F.coalesce("y", "doc_b").alias("q"))
    within = first.join(first.withColumnRenamed("id", "other"), "rep").where("id < other").select(F.col("id").alias("p"), F.col("other").alias("q"))
    rest = copies.where("rep != id").select(F.col("rep").alias("p"), F.col("id").alias("q"))
    every = across.unionByName(within).unionByName(rest)
    return every.select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b")).distinct()


def shared_parts(documents: DataFrame, spans: DataFrame, copies: DataFrame) -> DataFrame:
    """``doc_id, chars, shared_chars, spans, share``: how much of every document stands in others too; copies of a whole text
    are shared as a whole. Documents that share nothing have 0, and so have NULL texts."""
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    by = spans.groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = copies.select(F.col("id").alias("doc_id"), F.lit(True).alias("whole"))
    rows = docs.join(by, "doc_id", "left").join(whole, "doc_id", "left")
    shared = F.when(F.col("whole"), F.col("chars")).otherwise(F.coalesce("s", F.lit(0)))
    n = F.when(F.col("whole"), 1).otherwise(F.coalesce("n", F.lit(0)))
    share = F.when(F.col("chars") > 0, F.round(shared / F.col("chars"), 6)).otherwise(0.0)
    return rows.select("doc_id", "chars", shared.alias("shared_chars"), n.cast("bigint").alias("spans"), share.alias("share"))


def shared_stretches(documents: DataFrame, spans: DataFrame, copies: DataFrame) -> DataFrame:
    """``doc_id, start, stop`` of every stretch that stands in other documents too, from 0, without the stop; a copy of a
    whole text is one stretch."""
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("stop"))
    whole = docs.join(copies.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.lit(0).cast("bigint").alias("start"), "stop")
    parts = spans.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))
    return whole.unionByName(parts.join(whole.select("doc_id"), "doc_id", "left_anti"))
