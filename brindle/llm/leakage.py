"""Evaluation passages inside a training corpus: size-partitioned minhash containment search.

Every run of ``run`` words of a test item is a small query set, of its five-word sequences. Documents are cut into
overlapping pieces such that every run lies whole in one of them; pieces are partitioned by the size of their sets, and
each partition has its own number of bands and rows, chosen so that a piece that contains a query is missed with less than
the given probability. Pieces and queries with an equal band are verified word by word.

Of few test items, by a bound in bytes, an index goes to every task that reads documents. Of more, the bands are rows: those
of the documents that a bitmap of fixed size lets through meet the items' in a join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from brindle.llm.live import portions
from brindle.llm.near_duplicates import MULTIPLIERS, _mix
from brindle.runtime import cut

WORD = re.compile(r"[^\W_]+")


def choose_bands(similarity: float, miss: float, most: int) -> tuple[int, int]:
    """Bands and rows for pairs of at least this Jaccard similarity: as many rows as ``most`` hashes allow."""
    best = (math.ceil(math.log(miss) / math.log(1 - similarity)), 1) if similarity < 1 else (1, 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(miss) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


class Words:
    """Word hashes of texts, end to end."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The texts' words, their hashes, and where each text's begin (and the last's end)."""
        if len(self.known) > 300_000:
            self.known.clear()
        known, words, out = self.known, [], []
        for t in texts:
            own = WORD.findall(t.lower()) if "İ" not in t else [w.lower() for w in WORD.findall(t)]  # its small letter is two characters
            words.append(own)
            for w in own:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh3_64_intdigest(w)
                out.append(h)
        return words, np.array(out, np.uint64), np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)


def sequences(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; those that reach beyond a text's end are meaningless."""
    n = max(0, len(hashes) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = (h + hashes[j : j + n]) * np.uint64(MULTIPLIERS[j % len(MULTIPLIERS)])
        h ^= h >> np.uint64(29)
    return _mix(h)


class Index:
    """Bands of the query runs of test items. Small: about ``hashes`` keys a run."""

    def __init__(self, items: list[tuple[int, str]], run: int, width: int, stride: int, miss: float, hashes: int, seed: int = 9, keyed: bool = True):
        self.run, self.width, self.stride = run, width, stride
        self.span = stride + run - width  # sequences of a piece
        words, h, at = Words()([t for _, t in items])
        each = [np.arange(a, b - run + 1) for a, b in zip(at[:-1], at[1:])]
        place = np.concatenate([*each, np.zeros(0, np.int64)]).astype(np.int64)
        self.item = np.repeat(np.array([i for i, _ in items], np.int64), [len(e) for e in each])
        flat = [w for own in words for w in own]
        self.text = [" ".join(flat[p : p + run]) for p in place]
        if not keyed:
            return
        s = sequences(h, width)
        sets = s[place[:, None] + np.arange(run - width + 1)] if len(place) else np.zeros((0, run - width + 1), np.uint64)
        distinct = np.array([len(set(x)) for x in sets.tolist()], np.int64)
        least = run - width  # fewer distinct sequences than this: found by any one of them
        few = distinct < least
        self.single, self.single_run = sets[few, 0], np.nonzero(few)[0]
        order = np.argsort(self.single, kind="stable")
        self.single, self.single_run = self.single[order], self.single_run[order]
        uppers = sorted({min(self.span, math.ceil(least * f)) for f in (1.3, 1.8, 2.6, 99)})
        self.parts = [(u, *choose_bands(min(1.0, least / u), miss, hashes)) for u in uppers]
        count = max(b * r for _, b, r in self.parts)
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        full = np.nonzero(~few)[0]
        minima = np.stack([self.minhash(sets[full], j).min(axis=1) for j in range(count)], axis=1) if len(full) else np.zeros((0, count), np.uint32)
        for p, (_, bands, rows) in enumerate(self.parts):
            for band in range(bands):
                keys.append(self.key(p, band, minima[:, band * rows : (band + 1) * rows]))
                owners.append(full)
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.bits = max(16, min(24, int(len(keys) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def minhash(self, h: np.ndarray, j: int) -> np.ndarray:
        return ((h * self.a[j] + self.b[j]) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def key(part: int, band: int, minima: np.ndarray) -> np.ndarray:
        k = np.full(len(minima), (part * 1000 + band + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for j in range(minima.shape[1]):
            k = _mix(k ^ (minima[:, j].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        return k

    @staticmethod
    def matches(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``wanted`` and in ``sorted_keys`` of all equal pairs."""
        lo, hi = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(wanted)), n)
        return at, np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())

    def pieces(self, at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and last sequence of the pieces: from every stride-th word of a text, if a whole run follows."""
        length = np.diff(at)
        count = np.where(length >= self.run, (length - self.run) // self.stride + 1, 0)
        doc = np.repeat(np.arange(len(length)), count)
        nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        start = at[doc] + nth * self.stride
        return doc, start, np.minimum(start + self.span, at[doc + 1] - self.width + 1)

    def bands(self, s: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces and their keys, a band at a time."""
        # Equal sequences in a piece are few; its size counts them once.
        grid = s[np.minimum(start[:, None] + np.arange(self.span), len(s) - 1)]
        grid.sort(axis=1)
        sizes = np.minimum(stop - start, 1 + (grid[:, 1:] != grid[:, :-1]).sum(axis=1))
        edges = np.empty(2 * len(start), np.int64)
        edges[::2], edges[1::2] = start, stop
        part = np.searchsorted([u for u, _, _ in self.parts], sizes)
        minima: dict[int, np.ndarray] = {}
        for j in range(len(self.a)):
            if not any(j < b * r for p, (_, b, r) in enumerate(self.parts) if (part == p).any()):
                break
            minima[j] = np.minimum.reduceat(np.r_[self.minhash(s, j), np.uint32(2**32 - 1)], edges)[::2]
        for p, (_, bands, rows) in enumerate(self.parts):
            mine = np.nonzero(part == p)[0]
            if len(mine):
                for band in range(bands):
                    yield mine, self.key(p, band, np.stack([minima[j][mine] for j in range(band * rows, (band + 1) * rows)], axis=1))

    @staticmethod
    def holding(i: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which of the sequences ``i`` lie in a piece, and in which: a sequence lies in two at most."""
        piece = np.searchsorted(start, i, "right") - 1
        for back in (0, 1):
            p = np.maximum(piece - back, 0)
            ok = (start[p] <= i) & (i < stop[p])
            yield ok, p

    def search(self, texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of text position and run that the text contains."""
        none = np.zeros(0, np.int64)
        own, h, at = words(texts)
        s = sequences(h, self.width)
        if not len(s) or not len(self.item):
            return none, none
        doc, start, stop = self.pieces(at, s)
        if not len(start):
            return none, none
        found_piece, found_run = [none], [none]
        for mine, k in self.bands(s, start, stop):
            maybe = np.nonzero(self.seen[k >> np.uint64(64 - self.bits)])[0]
            i, j = self.matches(self.keys, k[maybe])
            found_piece.append(mine[maybe[i]]), found_run.append(self.owners[j])
        if len(self.single):
            i, j = self.matches(self.single, s)
            for ok, p in self.holding(i, start, stop):
                found_piece.append(p[ok]), found_run.append(self.single_run[j[ok]])
        piece, run = np.concatenate(found_piece), np.concatenate(found_run)
        both = np.unique(piece * (len(self.item) + 1) + run)
        piece, run = both // (len(self.item) + 1), both % (len(self.item) + 1)
        ok = np.zeros(len(piece), bool)
        joined: dict[int, str] = {}
        for n, (p, r) in enumerate(zip(piece.tolist(), run.tolist())):
            if p not in joined:
                a = start[p] - at[doc[p]]
                joined[p] = f" {' '.join(own[doc[p]][a : a + self.stride + self.run - 1])} "
            ok[n] = f" {self.text[r]} " in joined[p]
        both = np.unique(doc[piece[ok]] * (len(self.item) + 1) + run[ok])
        return both // (len(self.item) + 1), both % (len(self.item) + 1)


#: Bits of the bitmaps that keep most of the documents' keys out of the join.
BITS = 26


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which leading bits the keys have: 8 MB, however many they are."""
    place = F.shiftrightunsigned("key", 64 - BITS) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def _single_key(s: np.ndarray) -> np.ndarray:
    return _mix(s ^ np.uint64(0xA24BAED4963EE407))


def _joined(docs: DataFrame, items: DataFrame, scheme: Index, args: tuple) -> DataFrame:
    """``doc_id, item_id, runs`` by a join of bands. Runs of equal words are one, whatever the number of items."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "passage", 200, 200_000):
                x = Index(list(zip(b.column("item_id").to_pylist(), b.column("passage").to_pylist())), *args)
                key, at = np.r_[x.keys, _single_key(x.single)], np.r_[x.owners, x.single_run]
                single = np.arange(len(key)) >= len(x.keys)
                number = np.array([xxhash.xxh3_64_intdigest(t) for t in x.text], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(single), pa.array(number[at].view(np.int64))], names=["key", "single", "run"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "passage", 500):
                x = Index(list(zip(b.column("item_id").to_pylist(), b.column("passage").to_pylist())), *args, keyed=False)
                number = np.array([xxhash.xxh3_64_intdigest(t) for t in x.text], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.item), pa.array(number.view(np.int64)), pa.array(x.text, pa.string())], names=["item_id", "run", "words"])

    keys = cut(items.mapInArrow(keyed, "key BIGINT, single BOOLEAN, run BIGINT").distinct())
    banded, single = _bitmap(keys.where("NOT single")), _bitmap(keys.where("single"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for b in portions(whole, "text", 500, 1_000_000):
                own, h, at = words(b.column("text").to_pylist())
                s = sequences(h, scheme.width)
                doc, start, stop = scheme.pieces(at, s) if len(s) else (np.zeros(0, np.int64),) * 3
                hit_piece, hit_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                if len(start):
                    for mine, k in scheme.bands(s, start, stop):
                        maybe = _has(banded, k)
                        hit_piece.append(mine[maybe]), hit_key.append(k[maybe])
                    k = _single_key(s)
                    i = np.nonzero(_has(single, k))[0]
                    for ok, p in scheme.holding(i, start, stop):
                        hit_piece.append(p[ok]), hit_key.append(k[i[ok]])
                piece, key = np.concatenate(hit_piece), np.concatenate(hit_key)
                text = {}
                for p in np.unique(piece).tolist():
                    a = start[p] - at[doc[p]]
                    text[p] = " ".join(own[doc[p]][a : a + scheme.stride + scheme.run - 1])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("doc_id").take(pa.array(doc[piece] if len(piece) else piece)), pa.array([text[p] for p in piece.tolist()], pa.string())], names=["key", "doc_id", "piece"])

    of_items = items.mapInArrow(places, "item_id BIGINT, run BIGINT, words STRING").groupBy("run", "words", "item_id").agg(F.count(F.lit(1)).alias("n"))
    met = docs.mapInArrow(pieces, "key BIGINT, doc_id BIGINT, piece STRING").distinct().join(keys.select("key", "run").distinct(), "key").select("doc_id", "piece", "run").distinct()
    met = met.join(of_items.select("run", "words").distinct(), "run")
    inside = met.where(F.contains(F.concat(F.lit(" "), "piece", F.lit(" ")), F.concat(F.lit(" "), "words", F.lit(" ")))).select("doc_id", "words").distinct()
    return inside.join(of_items, "words").groupBy("doc_id", "item_id").agg(F.sum("n").alias("runs"))


def leaked_items(
    documents: DataFrame,
    passages: DataFrame,
    run: int = 10,
    width: int = 5,
    stride: int = 20,
    miss: float = 1e-6,
    hashes: int = 64,
    index_bytes: int = 64 << 20,
) -> DataFrame:
    """``doc_id, item_id, runs, share``: documents that contain at least ``run`` consecutive words of an item's passage.

    Words are runs of letters and digits in lower case. ``runs`` is the number of the item's places from which on ``run``
    words stand in the document, ``share`` their part of all of the item's places. Items of fewer words, NULL passages and
    texts, and rows without doc_id or item_id give nothing; of repeated item_ids every passage counts; a repeated doc_id
    gives its rows once for each text. If the items' index is estimated, from their words, at no more than ``index_bytes``,
    it goes to every task and documents aren't shuffled; otherwise nothing of the items but their number and two bitmaps of
    fixed size reaches the driver, and bands are joined.
    """
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = passages.where("item_id IS NOT NULL AND passage IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "passage")
    args = (run, width, stride, miss, hashes)
    scheme = Index([], *args)
    places = F.greatest(F.lit(0), F.size(F.split("passage", r"[^\p{L}\p{N}]+")) - run + 1)
    size = (items.agg(F.sum(places)).first()[0] or 0) * (16 * sum(b for _, b, _ in scheme.parts) + 300)
    if size > index_bytes:
        words = Words()
        total = items.mapInArrow(lambda bs: _places(bs, run, words), "item_id BIGINT, all BIGINT").groupBy("item_id").agg(F.sum("all").alias("all"))
        return _joined(docs, items, scheme, args).join(total, "item_id").select("doc_id", "item_id", "runs", (F.col("runs") / F.col("all")).alias("share"))
    rows = items.orderBy("item_id", "passage").collect()
    index = Index([(r["item_id"], r["passage"]) for r in rows], *args)
    every, counts = np.unique(index.item, return_counts=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = Words(), len(every) + 1
        of_run = np.searchsorted(every, index.item)
        for whole in batches:
            for b in portions(whole, "text", 500):
                doc, r = index.search(b.column("text").to_pylist(), words)
                both, count = np.unique(doc * n + of_run[r], return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(both // n)), pa.array(every[both % n]), pa.array(count.astype(np.int64)), pa.array(count / counts[both % n])], names=["doc_id", "item_id", "runs", "share"])

    return docs.mapInArrow(search, "doc_id BIGINT, item_id BIGINT, runs BIGINT, share DOUBLE")


def _places(batches: Iterator[pa.RecordBatch], run: int, words: Words) -> Iterator[pa.RecordBatch]:
    """How many runs each passage has."""
    for b in batches:
        _, _, at = words(b.column("passage").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(np.maximum(0, np.diff(at) - run + 1))], names=["item_id", "all"])
