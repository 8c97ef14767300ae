"""Sequence packing by patterns: non-negative least squares over a length histogram.

Documents become pieces of at most `size` tokens. The histogram of piece lengths (at most `size`
numbers, whatever the input) goes to the driver, which enumerates patterns of up to three lengths, fits
how often to use each by non-negative least squares, rounds those counts, and packs what is left
best-fit, into the room of the patterns first, also on counts. Patterns that fill a sequence and
those that leave some room are fitted apart; of these plans and of best fit alone the one with the fewest
sequences is taken. Each piece then finds its place from its length and
its rank among the pieces of that length: a sum of counts over partitions, not a global sort.

Defined cases: a null or empty text is its end token alone; pieces of a document longer than `size`
fill whole sequences but the first; equal lengths are interchangeable; an empty table gives no rows;
repeated rows are packed as documents of their own; null doc_ids stay.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import id_text, map_rows, stored

SIZE = 1024
END = 2
STEPS = 120  # of each least-squares fit


def pieces(df: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts pieces of this length in the
    partition `part`, so that ranks need no sort of all rows."""

    def make():
        bpe, seen, part = Bpe.of(path), [0] * (size + 1), TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()

        def each(batch):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text) + last
                n = len(ids) // 4
                at, k = 0, 0
                length = n % size or size
                while at < n:
                    rows.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, seen[length]))
                    seen[length] += 1
                    at, k, length = at + length, k + 1, size
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"), zip(*rows)))

        return each

    return map_rows(id_text(df), make, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long", "bpe", by=1)


def patterns(present: np.ndarray, full: bool) -> np.ndarray:
    """(a, b, c) with a >= b >= c >= 0 and b > 0, of lengths that are present; c = 0 is a pair. full: those that fill a sequence; else for
    each a and b that with the greatest c that there is room for."""
    size = len(present) - 1
    a, b = np.meshgrid(*[np.flatnonzero(present[1:]) + 1] * 2, indexing="ij")
    keep = (a >= b) & (a + b <= size)
    a, b = a[keep], b[keep]
    if full:
        c = size - a - b
        keep = (c <= b) & ((c == 0) | present[c])
    else:
        least = np.maximum.accumulate(np.where(present, np.arange(size + 1), 0))
        least[0] = 0
        c = least[np.minimum(size - a - b, b)]
        keep = np.ones(len(c), bool)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def fit(histogram: np.ndarray, rows: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes the patterns' lengths, each repeated x times, come nearest to the histogram, where room that a pattern leaves
    counts a little against it (accelerated projected gradient; the patterns are kept as three columns, never as a matrix)."""
    size = len(histogram) - 1

    def made(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(rows[:, k], x, size + 1) for k in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(made(v))
        v /= np.linalg.norm(v)
    rate = 1 / (np.linalg.norm(back(made(v))) * 1.02)
    x = y = np.zeros(len(rows))
    t = 1.0
    target = histogram.astype(float)
    target[0] = 0
    cost = (size - rows.sum(1)) * (0.01 * target.max() / size)
    for _ in range(steps):
        new = np.maximum(0, y - rate * (back(made(y) - target) + cost))
        if ((y - new) * (new - x)).sum() > 0:  # the momentum points uphill
            t = 1.0
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / ahead * (new - x), new, ahead
    return x


def best_fit(left: np.ndarray, begun: Counter | None = None) -> Counter:
    """{lengths of a sequence: how often}, longest pieces first, each into the least room that takes it; begun: sequences that there are
    already. Works on counts: as many steps as there are different (room, contents), not pieces."""
    size = len(left) - 1
    room: list[dict[tuple, int]] = [{} for _ in range(size + 1)]
    for key, times in (begun or {}).items():
        room[size - sum(key)][key] = times
    for length in range(size, 0, -1):
        n, at = int(left[length]), length
        while n:
            while at <= size and not room[at]:
                at += 1
            if at > size:
                k = size // length
                for copies, times in ((k, n // k), (n % k, 1)):
                    if copies and times:
                        key = (length,) * copies
                        room[size - length * copies][key] = room[size - length * copies].get(key, 0) + times
                break
            key, times = room[at].popitem()
            took = min(n, times)
            if times > took:
                room[at][key] = times - took
            room[at - length][(*key, length)] = room[at - length].get((*key, length), 0) + took
            n -= took
            if at - length >= length:
                at = length
    return Counter({k: v for r in room for k, v in r.items()})


def fitted(left: np.ndarray, full: bool) -> Counter:
    """The plan from one kind of patterns, with the residuals packed best-fit."""
    rows, left, out = patterns(left > 0, full), left.copy(), Counter()
    if len(rows):
        total = np.floor(np.cumsum(fit(left, rows)) + 0.5)
        whole = np.diff(total, prepend=0).astype(np.int64)  # rounded so that neighbours' sums are kept
        for k in np.lexsort((-whole, rows.sum(1).max() - rows.sum(1))):
            if not whole[k]:
                continue
            key = tuple(int(v) for v in rows[k] if v)
            need = Counter(key)
            n = min(int(whole[k]), *(int(left[v]) // m for v, m in need.items()))
            if n:
                out[key] += n
                for v, m in need.items():
                    left[v] -= n * m
    return best_fit(left, out)


def plan(histogram: np.ndarray) -> Counter:
    """{lengths of a sequence: how often} for histogram[length] pieces of each length."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    whole, left[size] = int(left[size]), 0
    plans = [best_fit(left), *(fitted(left, full) for full in (True, False) if left.any())]
    out = min(plans, key=lambda p: sum(p.values()))
    if whole:
        out[(size,)] += whole
    return out


def places(found: Counter, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sequences, offsets): rank r among the pieces of length l is in the entry before key
    l << 40 | r; entries are as many as the patterns have lengths, whatever the number of pieces."""
    used = np.zeros(size + 1, np.int64)
    keys, sequences, offsets, first = [], [], [], 0
    for lengths, times in found.items():
        offset = 0
        for v in lengths:
            keys.append(v << 40 | int(used[v]))
            sequences.append(first)
            offsets.append(offset)
            used[v] += times
            offset += v
        first += times
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(sequences, np.int64)[order], np.array(offsets, np.int64)[order]


def pack(spark: SparkSession, df: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    cut = stored(spark, pieces(df, path, size, end), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[row.length] = row.n
    keys, sequences, offsets = places(plan(histogram), size)

    def make():
        def each(batch):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            return out | {"sequence_id": pa.array(sequences[at] + rank - (keys[at] & ((1 << 40) - 1))), "offset": pa.array(offsets[at])}

        return each

    ranked = cut.join(before.select("length", "part", "base"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return map_rows(ranked, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
