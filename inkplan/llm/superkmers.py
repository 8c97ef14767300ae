"""Exact substring dedup of word windows by super-k-mers.

Consecutive 35-word windows that share a minimiser (the eight-word run of least hash) travel as one packed string of words to the
minimiser's bucket (module repeats). There equal strings are neighbours, and the windows of different ones are sorted by hash and
neighbours compared word for word, so they are counted exactly.

A word is removed if a window that covers it occurs anywhere else as well, in the same document or another. Of rows with the same
text one goes through the buckets, for all of them; all lose all their words, if there are as many as a window has.

Defined cases: null or empty text: no words, the digest of nothing; texts shorter than a window are kept whole; a null doc_id is a
document like others; texts that share a doc_id, or have none, are told apart by a hash, and each loses its own repeats; a row given
twice is two occurrences; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import texts
from .shingles import word_hashes

WINDOW, MINIMISER = 35, 8
#: Bytes of packed strings sorted at a time.
BUCKET = 4 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def symbols(text: str) -> np.ndarray:
    return word_hashes(words_of(text))


def cut(text: str):
    words = words_of(text)
    return lambda start, end: b" ".join(words[start:end])


def repeated(strings: list[bytes], n: np.ndarray, many: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For the n[i] windows of each packed string, one after the other: whether it occurs twice or more; a string that is
    `many` already stands for several."""
    words = [w for s in strings for w in s.split(b" ")]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    size = n + window - 1
    place = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    weight = np.repeat(np.where(many, 2, 1), n)
    h = repeats.Powers(word_hashes(words), window).runs(place, window)
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    near = np.flatnonzero(same)
    for step in range(0, len(near), 100_000):  # word for word
        i = near[step : step + 100_000]
        x, y = place[by[i]], place[by[i + 1]]
        equal = np.ones(len(i), bool)
        for k in range(window):
            equal &= ids[x + k] == ids[y + k]
        if not equal.all():  # a hash of two different windows: sort by the words themselves
            rows = np.lib.stride_tricks.sliding_window_view(ids, window)[place]
            classes = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
            return np.bincount(classes, weight)[classes] > 1
    classes = np.empty(len(by), np.int64)
    classes[by] = np.cumsum(np.concatenate([[False], ~same])) if len(by) else []
    return np.bincount(classes, weight)[classes] > 1


def left_of(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for start, end in ranges:
        out += words[at:start]
        at = end
    return out + words[at:]


def kept(spark: SparkSession, df: DataFrame, schema: str, result) -> DataFrame:
    """result(words, removed ranges) for each row, under the columns of schema after doc_id."""

    def apply(text: str, ranges: list[tuple[int, int]] | None) -> tuple:
        words = words_of(text)
        return result(words, ranges if ranges is not None else [(0, len(words))] if len(words) >= WINDOW else [])

    docs = repeats.once(spark, texts(df), "doc_id", "copy", "many")
    found = repeats.spans(
        spark, docs.where("not copy"), symbols, cut, lambda strings, n, many, order: repeated(strings, n, many), WINDOW, MINIMISER, False, BUCKET
    )
    return repeats.without(docs, found, F.col("many"), apply, WINDOW, f"doc_id long, {schema}")


def digests(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""

    def result(words: list[bytes], ranges: list[tuple[int, int]]) -> tuple:
        rest = left_of(words, ranges)
        return len(words), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()

    return kept(spark, df, "n_words long, n_removed long, kept_sha256 string", result)


def deduplicated(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(doc_id, kept string): the words that are left, joined by spaces."""
    return kept(spark, df, "kept string", lambda words, ranges: (b" ".join(left_of(words, ranges)).decode("utf-8", "surrogatepass"),))
