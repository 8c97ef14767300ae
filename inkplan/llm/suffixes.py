"""Exact substring dedup: repeated 100-byte strings by blockwise suffix sorting with a difference cover.

The suffixes that could be equal over `window` bytes are found by their minimisers (module repeats) and dealt into suffix buckets, as
strings of bytes. A bucket is sorted on its own, in bounded memory: suffixes are sorted by their first V bytes; ties are resolved by the ranks of a
cover sample. The sample holds the places whose remainder modulo V lies in a difference cover, so that any two places i, j have an
offset d < V for which i + d and j + d are both sampled. Two suffixes that agree on V bytes agree on `window` bytes exactly if the
sample suffixes at such a d have a common prefix of window - d bytes, which the sorted sample and its prefix lengths say.

A byte is removed if a `window`-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same one
(of several texts with one doc_id, the one of smaller key is first).

Of rows with the same text the one of least doc_id goes through the buckets; the others lose all of it, if it is as long as the window.

Defined cases: null or empty text: no bytes, nothing removed, the digest of nothing; texts shorter than the window are kept
whole; a null doc_id orders before all others; texts that share a doc_id, or have none, are told apart by a hash, and each loses its own
repeats; of a row given several times one is the first and the others are later; cutting may split characters, so kept text is bytes;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import NO_ID, fresh, text_key, texts
from .neardup import maybe_in
from .shingles import mix, odd

WINDOW, MINIMISER = 100, 24
V = 32
#: Bytes of a suffix bucket sorted at a time.
BUCKET = 1 << 20
BYTE = mix(odd(256, 37))


def difference_cover(v: int) -> np.ndarray:
    """A set whose differences modulo v are all of 0 .. v - 1, grown greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max((x for x in range(v) if x not in cover), key=lambda x: len(missing & {d for c in cover for d in ((x - c) % v, (c - x) % v)}))
        missing -= {d for c in cover for d in ((best - c) % v, (c - best) % v)}
        cover.append(best)
    inside = np.zeros(v, bool)
    inside[cover] = True
    return inside


COVER = difference_cover(V)


def symbols(text: str) -> np.ndarray:
    return BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def cut(text: str):
    raw = text.encode("utf-8", "surrogatepass")
    return lambda start, end: raw[start:end]


def common_prefix(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each but the first sorted suffix, the bytes it shares with the one before; words[t] are bytes 8t .. 8t + 7."""
    out = np.zeros(len(order), np.int32)
    going = np.arange(1, len(order))
    for w in words:
        if not len(going):
            break
        x = w[order[going]] ^ w[order[going - 1]]
        same = x == 0
        out[going] += np.where(same, 8, sum((x >> np.uint64(64 - 8 * b) == 0).astype(np.int32) for b in range(1, 8)))
        going = going[same]
    return out


def later(strings: list[bytes], n: np.ndarray, order: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For the n[i] windows at the beginning of each strings[i], one after the other: whether an equal one starts earlier.
    order: ranks of the strings in the corpus."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    place = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rank = np.repeat(order, n)
    depth = -(-window // 8)
    wide = np.zeros(len(text) + 8 * depth + 8, np.uint64)
    for j in range(8):
        wide[: len(text) - j] |= text[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    head = [wide[place + 8 * t] for t in range(V // 8)]
    by = np.lexsort(head[::-1])
    differs = np.zeros(len(by), bool)
    for w in head:
        differs[1:] |= w[by[1:]] != w[by[:-1]]
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(differs)
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    out = np.zeros(len(place), bool)
    if not len(tied):
        return out
    sample = np.flatnonzero(COVER[np.arange(len(text)) % V])
    words = [wide[sample + 8 * t] for t in range(depth)]
    sorted_sample = np.lexsort(words[::-1])
    shared = common_prefix(words, sorted_sample)
    at = np.full(len(text) + V, -1, np.int64)
    at[sample[sorted_sample]] = np.arange(len(sample))
    for d in range(V):
        sub = tied[COVER[(place[tied] + d) % V]]
        classes = np.cumsum(shared < window - d)
        key = group[sub] << 32 | classes[at[place[sub] + d]]
        o = np.lexsort((rank[sub], key))
        out[sub[o[1:]]] |= key[o[1:]] == key[o[:-1]]
    return out


def covered(spark: SparkSession, first: DataFrame) -> DataFrame:
    """SPAN rows of repeats: the windows of each text that start earlier somewhere. first: (doc_id, text, key, many)."""
    return repeats.spans(
        spark, first, symbols, cut, lambda strings, n, many, order: later(strings, n, order), WINDOW, MINIMISER, True, BUCKET
    )


def kept(spark: SparkSession, df: DataFrame, schema: str, result) -> DataFrame:
    """result(raw bytes, removed ranges) for each row, under the columns of schema after doc_id."""

    def apply(text: str, ranges: list[tuple[int, int]] | None) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        return result(raw, removed(len(raw), ranges))

    docs = repeats.once(spark, texts(df), "doc_id", "copy", "many")
    found = covered(spark, docs.where("not copy"))
    return repeats.without(docs, found, F.col("copy"), apply, WINDOW, f"doc_id long, {schema}")


def removed(size: int, ranges: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """The ranges; for None the whole text, if a window fits into it."""
    return ranges if ranges is not None else [(0, size)] if size >= WINDOW else []


def left_of(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in ranges:
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]])


def digests(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""

    def result(raw: bytes, ranges: list[tuple[int, int]]) -> tuple:
        rest = left_of(raw, ranges)
        return len(raw), len(raw) - len(rest), len(ranges), hashlib.sha256(rest).hexdigest()

    return kept(spark, df, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", result)


def deduplicated(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(doc_id, kept binary): what is left of each text."""
    return kept(spark, df, "kept binary", lambda raw, ranges: (left_of(raw, ranges),))


def rewritten(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df with what is left of each text, and all its other columns; characters cut in two go as a whole, and n_chars, if
    df has it, follows. Only documents that may have lost something are shuffled."""
    key, own, copy, many, doc, doc_own, rows, maybe = (fresh(df, c) for c in ("_key", "_own", "_copy", "_many", "_doc", "_doc_own", "_rows", "_maybe"))
    names = [F.col(f"`{c}`") for c in df.columns]
    some = df.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own, text_key())
    some = repeats.once(spark, some, key, copy, many)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    found = covered(spark, some.where(~F.col(copy)).select(F.col(key).alias("doc_id"), text, F.col(own).alias("key"), F.col(many).alias("many")))
    listed = repeats.by_document(found, (repeats.SPAN,), ("start", "n")).toDF(doc, doc_own, rows)

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series, copies: pd.Series) -> pd.Series:
        def one(text, some, whole):
            if text is None or some is None and not whole:
                return text
            raw = text.encode("utf-8", "surrogatepass")
            return left_of(raw, removed(len(raw), None if whole else repeats.covered(list(some), WINDOW))).decode("utf-8", "ignore")

        return pd.Series([one(t, s, c) for t, s, c in zip(texts, spans, copies)], dtype=object)

    some = maybe_in(some, found, (key, own), ("doc", "key"), maybe).withColumn(maybe, F.col(maybe) & ~F.col(copy))
    met = some.where(F.col(maybe)).join(listed, (F.col(key) == F.col(doc)) & (F.col(own) == F.col(doc_own)), "left").select(*names, rows, copy)
    met = met.union(some.where(copy).select(*names, F.lit(None).cast(met.schema[rows].dataType).alias(rows), copy))
    met = met.withColumn("text", rest(F.col("text").cast("string"), rows, copy))
    met = met.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else met
    return some.where(~F.col(maybe) & ~F.col(copy)).select(*names).union(met.select(*names))
