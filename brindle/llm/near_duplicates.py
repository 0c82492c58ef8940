"""Groups of near-duplicate records: minhash bands, verification, connected components.

Texts are compared by the sets of their word sequences: many universal hash minima make a signature, bands of which are
the keys under which similar texts meet. Records without text are compared by their vectors in the same way, with the
signs of random projections as signature. Copies are represented by one record from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from brindle.llm.components import connected_components
from brindle.llm.live import matrix, portions, unit, usable
from brindle.runtime import cut

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def normal_text(text):
    """Words in lower case, with single spaces between them. Words are found first: a capital may become two characters."""
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def no_text(text: str):
    """NULL, or nothing but white space."""
    return F.col(text).isNull() | F.col(text).rlike(r"(?U)^\s*$")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Hashes of the sequences of ``width`` words, distinct within a text."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts, those of a text sorted, and where each text's begin (and the last's end)."""
        if len(self.known) > 300_000:
            self.known.clear()
        known, words, sizes = self.known, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.split(" ")
            for w in own:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh3_64_intdigest(w)
                words.append(h)
            sizes[i] = len(own)
        w = np.array(words, np.uint64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        k = self.width
        if len(w) < k:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = (h + w[j : len(w) - k + 1 + j]) * np.uint64(MULTIPLIERS[j % len(MULTIPLIERS)])
            h ^= h >> np.uint64(29)
        whole = doc[: len(h)] == doc[k - 1 :]
        h, doc = _mix(h[whole]), doc[: len(h)][whole]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, at: np.ndarray, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``count`` hash minima (32 bits) of every text that has shingles, and which texts these are."""
    has = np.nonzero(at[1:] > at[:-1])[0]
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)
    sig = np.empty((len(has), count), np.uint32)
    if len(has):
        for j in range(count):
            sig[:, j] = np.minimum.reduceat(((h * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), at[has])
    return sig, has


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every band of ``rows`` columns; equal rows of different bands have different keys."""
    n, bands = len(sig), sig.shape[1] // rows
    parts = sig[:, : bands * rows].astype(np.uint64).reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for j in range(rows):
        key = _mix(key ^ (parts[:, :, j] + np.uint64(0x632BE59BD9B4E019)))
    return key.view(np.int64)


def _pairs_of_runs(key: np.ndarray, uid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of each run of equal keys of at most ``most`` rows; keys and uids of the longer runs."""
    start = np.r_[0, np.nonzero(key[1:] != key[:-1])[0] + 1]
    size = np.diff(np.r_[start, len(key)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    longest = size[size <= most].max(initial=0)
    for gap in range(1, longest):
        i = start[(size > gap) & (size <= most)]
        n = size[(size > gap) & (size <= most)] - gap
        first = np.repeat(i - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        a.append(uid[first]), b.append(uid[first + gap])
    hot = np.repeat(size > most, size)
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b), key[hot], uid[hot]


def candidate_pairs(keys: DataFrame, members: DataFrame, same: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], most: int = 64, block_rows: int = 512) -> DataFrame:
    """Distinct pairs ``a < b`` of uids that share a key. keys: ``key, uid``; members: ``uid`` and what ``same`` needs.

    Keys are sorted within partitions, and their rows stream by. The rows of a key with more than ``most`` go, by a hash,
    to blocks of about ``block_rows``, every two of which meet in a task of their own; ``same`` returns the positions of
    the likely pairs, so that no pairs are written which aren't.
    """
    pairs, hot = _met(keys, most)
    if hot.isEmpty():
        return pairs
    return pairs.unionByName(_across(hot, hot, members, same, block_rows)).distinct()


def spanning_links(keys: DataFrame, members: DataFrame, same, verify: Callable[[DataFrame], DataFrame], most: int = 64, block_rows: int = 512, rounds: int = 3, certain: Callable[[pa.Table, pa.Table], Callable[[int, int], bool]] | None = None) -> DataFrame:
    """Verified links ``a, b`` of uids that share a key: enough of them to connect whatever all of them connect.

    The rows of a key with more than ``most`` are first compared with one of them, ``rounds`` times, which leaves few that
    aren't connected. Two rows of a key that all links so far leave in different components are then compared, in blocks,
    whatever one they were linked to; rows of one component need no further links. ``certain`` gives, for two blocks, a test
    of a pair of positions, with which a block writes no more pairs than connect its components. A key whose rows are near
    copies of each other costs its rows, not their pairs.
    """
    pairs, hot = _met(keys, most)
    links = verify(pairs)
    rest = hot
    for turn in range(rounds):
        if rest.isEmpty():
            if turn <= 1:  # all rows of a key are linked to the same one
                return links
            break
        star = rest.join(rest.groupBy("key").agg(F.min("uid").alias("hub")), "key").where("uid != hub")
        linked = cut(verify(star.select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct()))
        links = links.unionByName(linked)
        rest = cut(star.join(linked.select(F.col("a").alias("hub"), F.col("b").alias("uid")), ["hub", "uid"], "left_anti").select("key", "uid"))
    links = cut(links)
    known = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "uid")
    hot = cut(hot.join(known, "uid", "left").select("key", "uid", F.coalesce("component", "uid").alias("component")))
    of_key = hot.groupBy("key").agg(F.mode("component", True).alias("common"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    apart = cut(hot.join(of_key.where("lo != hi").select("key", "common"), "key"))
    if apart.isEmpty():
        return links
    return links.unionByName(verify(_across(apart.where("component != common").drop("common"), apart.drop("common"), members, same, block_rows, certain).distinct()))


def _met(keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a, b`` of the uids of keys with at most ``most`` rows, and ``key, uid`` of the others."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_uid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        going: int | None = None  # the hot key whose rows are passing

        def out(a, b, hot_key, hot_uid):
            n, m = len(a), len(hot_key)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a, hot_uid]), pa.array(np.r_[b, hot_key]), pa.array(np.r_[np.zeros(n, bool), np.ones(m, bool)])], names=["a", "b", "hot"])

        for batch in batches:
            key, uid = np.r_[rest_key, np.asarray(batch.column("key"))], np.r_[rest_uid, np.asarray(batch.column("uid"))]
            if not len(key):
                continue
            if going is not None:
                n = int(np.argmax(key != going)) if (key != going).any() else len(key)
                yield out(key[:0], key[:0], key[:n], uid[:n])
                key, uid = key[n:], uid[n:]
                if not len(key):
                    rest_key, rest_uid = key, uid
                    continue
                going = None
            last = int(np.argmax(key == key[-1])) if key[0] != key[-1] else 0
            yield out(*_pairs_of_runs(key[:last], uid[:last], most)) if last else out(key[:0], key[:0], key[:0], uid[:0])
            rest_key, rest_uid = key[last:], uid[last:]
            if len(rest_key) > most:
                going = int(rest_key[0])
                yield out(key[:0], key[:0], rest_key, rest_uid)
                rest_key, rest_uid = key[:0], uid[:0]
        if len(rest_key):
            yield out(*_pairs_of_runs(rest_key, rest_uid, most))

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a BIGINT, b BIGINT, hot BOOLEAN").distinct())
    return met.where("NOT hot").select("a", "b"), met.where("hot").select(F.col("b").alias("key"), F.col("a").alias("uid"))


def _across(some: DataFrame, hot: DataFrame, members: DataFrame, same, block_rows: int, certain=None) -> DataFrame:
    """Likely pairs ``a < b`` of the rows ``some`` of keys with all rows ``hot`` of the same keys, block by block; both are
    ``key, uid`` or ``key, uid, component``. With components, a block gives pairs of different ones, only certain ones
    and as many as connect what these connect if there is a test."""
    own = [c for c in hot.columns if c == "component"]
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    few = some.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("asking"))
    number = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = blocks.join(few, "key")
    left = some.join(sizes, "key").select("key", "uid", *own, number("asking").alias("x"), every("parts").alias("y"), F.lit(True).alias("asks"))
    right = hot.join(sizes, "key").select("key", "uid", *own, every("asking").alias("x"), number("parts").alias("y"), F.lit(False).alias("asks"))
    placed = left.unionByName(right).join(members, "uid")

    def blocked(t: pa.Table) -> pa.Table:
        asks = np.asarray(t["asks"])
        left, right = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        i, j = same(left, right)
        if own:
            x, y = np.asarray(left["component"])[i], np.asarray(right["component"])[j]
            n = np.nonzero(x != y)[0] if certain is None else _joining(i, j, x, y, certain(left, right))
            i, j = i[n], j[n]
        a, b = np.asarray(left["uid"])[i], np.asarray(right["uid"])[j]
        keep = a != b
        return pa.table({"a": pa.array(np.minimum(a, b)[keep], pa.int64()), "b": pa.array(np.maximum(a, b)[keep], pa.int64())})

    return placed.groupBy("key", "x", "y").applyInArrow(blocked, "a BIGINT, b BIGINT")


def _joining(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, certain: Callable[[int, int], bool]) -> np.ndarray:
    """Places of certain pairs ``i, j`` of rows of the components ``x, y`` that join all components that certain pairs join."""
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while (above := up.get(c, c)) != c:
            up[c] = c = up.get(above, above)
        return c

    keep = []
    for n in np.nonzero(x != y)[0].tolist():
        p, q = top(int(x[n])), top(int(y[n]))
        if p != q and certain(int(i[n]), int(j[n])):
            up[p] = q
            keep.append(n)
    return np.array(keep, np.int64)


def _copies(df: DataFrame, column: str) -> DataFrame:
    """``id, rep`` of records with equal content; rep is the class's least id. Records without copy get no row."""
    keyed = df.select("id", F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(1), column).alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(classes, ["h1", "h2"]).select("id", "rep")


def _numbered(df: DataFrame, copies: DataFrame) -> DataFrame:
    return cut(df.join(copies.where("id != rep").select("id"), "id", "left_anti").withColumn("uid", F.monotonically_increasing_id()))


def text_links(texts: DataFrame, width: int, least: float, bands: int, rows: int, spanning: bool = False) -> DataFrame:
    """Pairs ``a, b`` of uids whose word sequences have a Jaccard similarity of at least ``least``; with ``spanning`` only as
    many as connect the same texts. texts: ``uid, words``.

    Minima of ``bands * rows`` universal hashes; a pair of similarity ``s`` meets with probability
    ``1 - (1 - s^rows)^bands``. Pairs that meet are verified by their signatures (four standard deviations below
    ``least`` are let through) and then by their exact sets.
    """
    count = bands * rows
    slack = least - 4 * (least * (1 - least) / count) ** 0.5

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for whole in batches:
            for b in portions(whole, "words", 2000):
                sig, has = signatures(*shingles(b.column("words").to_pylist()), count)
                key = band_keys(sig, rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.asarray(b.column("uid"))[has], key.shape[1]))], names=["key", "uid"])

    def overlap(p: np.ndarray, q: np.ndarray) -> bool:
        common = len(np.intersect1d(p, q, assume_unique=True))
        return common >= least * (len(p) + len(q) - common) - 1e-9

    def alike(x: list[str], y: list[str], shingles: Shingler) -> np.ndarray:
        h, at = shingles(x + y)
        n = len(x)
        sig, has = signatures(h, at, count)
        full = np.zeros((2 * n, count), np.uint32)
        full[has] = sig
        sizes = np.diff(at)
        ok = (sizes[:n] > 0) & (sizes[n:] > 0) & ((full[:n] == full[n:]).mean(axis=1) >= slack)
        for i in np.nonzero(ok)[0]:
            ok[i] = overlap(h[at[i] : at[i + 1]], h[at[n + i] : at[n + i + 1]])
        return ok

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for whole in batches:
            for b in portions(whole, "x", 1000):
                yield b.select(["a", "b"]).filter(pa.array(alike(b.column("x").to_pylist(), b.column("y").to_pylist(), shingles)))

    def same(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        shingles = Shingler(width)
        full = []
        for t in (left, right):
            sig, has = signatures(*shingles(t["words"].to_pylist()), count)
            whole = np.zeros((len(t), count), np.uint32)
            whole[has] = sig
            full.append(whole)
        near = [np.nonzero((full[1] == row).mean(axis=1) >= slack)[0] for row in full[0]]
        return np.repeat(np.arange(len(near)), [len(x) for x in near]), np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64)

    def certain(left: pa.Table, right: pa.Table) -> Callable[[int, int], bool]:
        shingles = Shingler(width)
        (h, at), (g, to) = (shingles(t["words"].to_pylist()) for t in (left, right))
        return lambda i, j: overlap(h[at[i] : at[i + 1]], g[to[j] : to[j + 1]])

    x, y = texts.select(F.col("uid").alias("a"), F.col("words").alias("x")), texts.select(F.col("uid").alias("b"), F.col("words").alias("y"))
    verified = lambda pairs: pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, "a BIGINT, b BIGINT")
    keyed, members = texts.select("uid", "words").mapInArrow(keys, "key BIGINT, uid BIGINT"), texts.select("uid", "words")
    return spanning_links(keyed, members, same, verified, certain=certain) if spanning else verified(candidate_pairs(keyed, members, same))


def vector_links(vectors: DataFrame, least: float, bands: int, bits: int, seed: int = 3, spanning: bool = False) -> DataFrame:
    """Pairs ``a, b`` of uids whose vectors have a cosine of at least ``least``, see ``text_links``. vectors: ``uid, v``.

    The signature is the signs of ``bands * bits`` random projections; pairs with an equal band are verified in double.
    """
    dim = 64
    planes = np.random.default_rng(seed).standard_normal((dim, bands * bits)).astype(np.float32)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                signs = (unit(matrix(b.column("v"))).astype(np.float32) @ planes > 0).reshape(b.num_rows * bands, bits)
                packed = (signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).reshape(-1, bands)
                key = _mix(packed + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.asarray(b.column("uid")), bands))], names=["key", "uid"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", unit(matrix(b.column("x"))), unit(matrix(b.column("y"))))
            yield b.select(["a", "b"]).filter(pa.array(s >= least - 1e-12))

    def same(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(unit(matrix(left["v"])) @ unit(matrix(right["v"])).T >= least - 1e-9)

    def certain(left: pa.Table, right: pa.Table) -> Callable[[int, int], bool]:
        p, q = unit(matrix(left["v"])), unit(matrix(right["v"]))
        return lambda i, j: np.einsum("nd,nd->n", p[i : i + 1], q[j : j + 1])[0] >= least - 1e-12

    x, y = vectors.select(F.col("uid").alias("a"), F.col("v").alias("x")), vectors.select(F.col("uid").alias("b"), F.col("v").alias("y"))
    verified = lambda pairs: pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, "a BIGINT, b BIGINT")
    keyed, members = vectors.select("uid", "v").mapInArrow(keys, "key BIGINT, uid BIGINT"), vectors.select("uid", "v")
    return spanning_links(keyed, members, same, verified, certain=certain) if spanning else verified(candidate_pairs(keyed, members, same))


def near_duplicate_groups(
    records: DataFrame,
    width: int = 5,
    text_similarity: float = 0.8,
    vector_similarity: float = 0.98,
    bands: int = 40,
    rows: int = 3,
    sign_bands: int = 48,
    sign_bits: int = 24,
    dim: int = 64,
) -> DataFrame:
    """``id, group_id, rep``: the group of every record that has a near-duplicate.

    Two records are linked if both have a text and the sets of their ``width``-word sequences have at least
    ``text_similarity`` in common (Jaccard), or if neither has a text (NULL or blank) and their usable vectors have a cosine
    of at least ``vector_similarity``; groups are connected records. ``group_id`` is one of the group's ids, ``rep`` the
    least id with the same words or vector. Texts of fewer than ``width`` words have no sequence and are linked to nothing,
    like records without id and records with neither text nor usable vector.
    records: one row an id, with ``text`` and ``vector``; other columns are ignored.
    """
    words, vector = normal_text(F.col("text")), F.when(no_text("text") & usable("vector", dim), F.col("vector").cast("array<float>"))
    r = records.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), words.alias("words"), vector.alias("v"))
    r = cut(r.where((F.size(F.split("words", " ")) >= width) | F.col("v").isNotNull()))
    words, plain = r.where("v IS NULL").select("id", "words"), r.where("v IS NOT NULL").select("id", "v")
    same_text, same_vector = cut(_copies(words, "words")), cut(_copies(plain, "v"))
    texts, vectors = _numbered(words, same_text), _numbered(plain, same_vector)
    shift = 1 << 62  # uids of texts and vectors come from two counters
    links = text_links(texts, width, text_similarity, bands, rows, True).unionByName(
        vector_links(vectors, vector_similarity, sign_bands, sign_bits, spanning=True).select((F.col("a") + shift).alias("a"), (F.col("b") + shift).alias("b"))
    )
    comps = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    names = texts.select("uid", "id").unionByName(vectors.select((F.col("uid") + shift).alias("uid"), "id"))
    named = names.join(comps.withColumnRenamed("node", "uid"), "uid").select(F.col("id").alias("rep"), "component")
    named = named.join(names.select(F.col("uid").alias("component"), F.col("id").alias("group_id")), "component").select("rep", "group_id")
    copies = same_text.unionByName(same_vector)
    # Classes of copies that are linked to nothing else are groups by themselves.
    every = copies.join(named, "rep", "left").select("id", F.coalesce("group_id", "rep").alias("group_id"), "rep")
    single = named.join(copies.where("id = rep").select("rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "group_id", "rep")
    return every.unionByName(single)


def group_pairs(groups: DataFrame, copies: int = 20) -> DataFrame:
    """``id_a, id_b``: pairs of records in one group, each once, the smaller id first.

    Of a class of copies, the first ``copies`` by id are paired with all of the group; further ones only with their
    class's representative, which keeps the group whole without a square number of rows.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    first = groups.withColumn("place", place).where(F.col("place") <= copies).select("id", "group_id", "rep")
    a, b = first.select("group_id", F.col("id").alias("id_a")), first.select("group_id", F.col("id").alias("id_b"))
    main = a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b")
    many = groups.groupBy("rep").count().where(F.col("count") > copies).select("rep")
    rest = groups.join(many, "rep").where("rep < id").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    return main.unionByName(rest).distinct()
