"""Tokeniser: as column expressions for documents, in Python for query literals."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

# The words that documents' tokens leave out.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might shall can not no nor so yet both either neither each few more most other some such than then too "
    "very just also as if its it this that these those i me my we our you your he she they them his her their what which who "
    "whom how when where why all any into through during before after above below up down out off over under again further "
    "once here there while about against between own same only s t re ve ll d m"
).split()

# Suffixes in the order in which they are tried.
SUFFIXES = ("tion", "ness", "ment", "ing", "ed", "er", "es", "ly")

_SPLIT = r"[^\p{IsAlphabetic}\p{N}']+"


def tokens(text: Column | str, stopwords: bool = True, suffixes: bool = False, shortest: int = 2, longest: int = 64) -> Column:
    """Array of a text's tokens, in order: runs of letters, digits and inner apostrophes, in lower case, of ``shortest`` to
    ``longest`` bytes, without stop words. NULL text: NULL."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.transform(F.split(text, _SPLIT), lambda w: F.lower(F.trim(w, F.lit("'"))))
    keep = lambda w: F.octet_length(w).between(shortest, longest)
    words = F.filter(words, lambda w: keep(w) & ~w.isin(STOPWORDS)) if stopwords else F.filter(words, lambda w: keep(w))
    return F.transform(words, strip_suffix) if suffixes else words


def once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """``df`` with a costly column that is computed once a row: below a generator, no filter or projection that uses it can be
    merged with it and compute it again."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def strip_suffix(word: Column) -> Column:
    """Without the first suffix, in the order tried, that leaves more than 3 bytes."""
    out = word
    for s in reversed(SUFFIXES):
        cut = F.substring(word, F.lit(1), F.length(word) - len(s))
        out = F.when((F.octet_length(word) > len(s) + 3) & word.endswith(s), cut).otherwise(out)
    return out


def query_tokens(text: str) -> list[str]:
    """Tokens of a query, stop words included."""
    words = (w.strip("'").lower() for w in re.findall(r"(?:[^\W_]|')+", text))
    return [w for w in words if 2 <= len(w.encode()) <= 64]


def query_weights(text: str) -> dict[str, int]:
    return dict(Counter(query_tokens(text)))


def term_frequencies(docs: DataFrame, id_col: str = "id", text: str = "text", **options) -> DataFrame:
    """``id, term, tf``: how often each token stands in each document."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(text, **options)).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
