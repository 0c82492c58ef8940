"""How characteristic a term is of its record: parsimonious language models.

A record's words are taken to come from a mixture of its own model and its collection's; expectation-maximisation finds
the record's own model, in which common terms lose their mass to the background and what stays ranks the terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def em(count: np.ndarray, background: np.ndarray, start: np.ndarray, weight: float, rounds: int, tolerance: float) -> np.ndarray:
    """Own probabilities of the terms of many records at once; a record's terms stand together, from ``start`` on."""
    size = np.diff(np.r_[start, len(count)])
    own = count / np.repeat(np.add.reduceat(count, start), size)
    for _ in range(rounds):
        expected = count * weight * own / ((1 - weight) * background + weight * own)
        new = expected / np.repeat(np.maximum(np.add.reduceat(expected, start), 1e-300), size)
        done = np.abs(new - own).max() < tolerance
        own = new
        if done:
            break
    return own


def distinct_postings(postings: DataFrame, live: DataFrame | None, lengths: DataFrame | None = None) -> DataFrame:
    """``collection_name, id, term, raw_count``, one row for each term of a record.

    Of repeated rows the largest ``raw_count`` counts; where that is missing, ``term_frequency`` times the record's largest
    length is rounded. Rows without collection, id or term, or without any positive count, are left out, and so are, if
    ``live`` (``id, collection_name``) is given, those of other records.
    """
    p = postings.where("collection_name IS NOT NULL AND id IS NOT NULL AND term IS NOT NULL")
    counted = p.where("raw_count > 0").select("collection_name", "id", "term", "raw_count")
    if lengths is not None:
        # Parquet skips what has no NULLs, so this branch costs nothing where there is none.
        known = lengths.groupBy("collection_name", "id").agg(F.max("doc_length").alias("dl"))
        lacking = p.where("raw_count IS NULL AND term_frequency > 0").join(known, ["collection_name", "id"])
        estimate = F.round(F.col("term_frequency") * F.col("dl")).cast("bigint").alias("raw_count")
        counted = counted.unionByName(lacking.select("collection_name", "id", "term", estimate).where("raw_count > 0"))
    if live is not None:
        # A hash table of a partition's live ids spares sorting the postings.
        counted = counted.join(live.select("id", "collection_name").hint("shuffle_hash"), ["id", "collection_name"], "left_semi")
    return counted.groupBy("collection_name", "id", "term").agg(F.max("raw_count").alias("raw_count"))


def term_statistics(postings: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``collection_name, term, df, share, n``: of a term the records that have it and its part of all words, of the
    collection the number of records. postings: distinct ones; ``records`` (``collection_name, id``), if given, holds the same records and
    is cheaper to count."""
    terms = postings.groupBy("collection_name", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("raw_count").alias("cf"))
    words = terms.groupBy("collection_name").agg(F.sum("cf").alias("words"))
    each = (postings if records is None else records).select("collection_name", "id").distinct()
    totals = words.join(each.groupBy("collection_name").agg(F.count(F.lit(1)).alias("n")), "collection_name")
    return terms.join(totals, "collection_name").select("collection_name", "term", "df", (F.col("cf") / F.col("words")).alias("share"), "n")


def characteristic_terms(
    postings: DataFrame, records: DataFrame | None = None, weight: float = 0.1, rounds: int = 50, tolerance: float = 1e-5
) -> DataFrame:
    """All terms of all records with their probability in the record's own model: ``collection_name, id, term, probability, place, raw_count, terms,
    weight, rival``.

    ``place`` is the term's rank in the record by probability (ties: smaller term), ``terms`` the number of the record's
    distinct terms. ``weight`` is the mixture's part that the record's own model is to explain; common terms keep next to
    no probability. For exact checks there are, with
    ``doc_length`` the sum of the record's counts, the term's ``weight``, ``raw_count / doc_length *
    ln((n - df + 0.5) / (df + 0.5) + 1)``, and the ``rival``, the largest weight of all other terms of the record (NULL if
    it has none). postings: distinct ones (``distinct_postings``), records: see ``term_statistics``; an empty table gives no
    rows.
    """
    stats = term_statistics(postings, records)
    rows = postings.join(stats.hint("shuffle_hash"), ["collection_name", "term"])
    records = rows.groupBy("collection_name", "id").agg(F.collect_list(F.struct("term", "raw_count", "share", "df", "n")).alias("t"))

    def models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                t = b.column("t")
                offsets = np.asarray(t.offsets)[: b.num_rows + 1] - t.offsets[0].as_py()
                flat = t.flatten()
                size, start = np.diff(offsets), offsets[:-1]
                count = np.asarray(flat.field("raw_count")).astype(np.float64)
                own = em(count, np.asarray(flat.field("share")), start, weight, rounds, tolerance)
                doc = np.repeat(np.arange(b.num_rows), size)
                _, word = np.unique(np.asarray(flat.field("term").to_pylist(), object).astype(str), return_inverse=True)
                order = np.lexsort((word, -own, doc))
                place = np.empty(len(own), np.int32)
                place[order] = np.arange(len(own)) - np.repeat(start, size) + 1
                df, n = (np.asarray(flat.field(x)).astype(np.float64) for x in ("df", "n"))
                heavy = count / np.repeat(np.add.reduceat(count, start), size) * np.log((n - df + 0.5) / (df + 0.5) + 1)
                order = np.lexsort((-heavy, doc))
                first, second = order[start], order[np.minimum(start + 1, len(own) - 1)]
                rival = np.repeat(heavy[first], size)
                rival[first] = np.where(size > 1, heavy[second], np.nan)
                columns = {
                    "collection_name": b.column("collection_name").take(pa.array(doc)), "id": b.column("id").take(pa.array(doc)), "term": flat.field("term"),
                    "probability": pa.array(own), "place": pa.array(place), "raw_count": flat.field("raw_count"), "terms": pa.array(np.repeat(size, size).astype(np.int32)),
                    "weight": pa.array(heavy), "rival": pa.array(rival, from_pandas=True),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return records.mapInArrow(
        models, "collection_name STRING, id STRING, term STRING, probability DOUBLE, place INT, raw_count BIGINT, terms INT, weight DOUBLE, rival DOUBLE"
    )


def outstanding_terms(terms: DataFrame, ratio: float = 1.7) -> DataFrame:
    """``id, term``: of records with at least two terms, the characteristic term whose weight is at least ``ratio`` times
    that of every other term of the record. terms: ``characteristic_terms``."""
    return terms.where((F.col("terms") >= 2) & (F.col("weight") >= ratio * F.col("rival"))).select("id", "term")
