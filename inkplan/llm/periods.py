"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye, over the stretches of a slice of texts at once.

A run is a stretch of words with smallest period q, at least `times` * q and `least` words long, that can't be made longer. Every window of
`times` - 1 words in it occurs in it again, q words on or back, so words of which no such window occurs again in their text can't be in a run: what is left
of the texts falls apart into stretches (by hashes; equal hashes of different windows make a stretch longer, never shorter). The stretches of
a slice are laid end to end, each closed by a symbol of its own, and make one string:

1. Text: names for all substrings of 1, 2, 4, ... words (by sorting pairs of names) give the suffix array and, by comparing names from the longest
   to the shortest, the common extension of any two places ahead and behind.
2. blocks(): the Lempel-Ziv blocks, from each place's longest earlier occurrence, which one of its neighbours of earlier start in the suffix array has.
3. covering(): squares (a word sequence twice in a row) about the border of each block and its neighbour; they cover the leftmost occurrence of every square.
4. vocabulary(): from each of these, suffix links lead from a rotation to the next as long as the square goes on; each square is known by its place in the
   suffix tree, which is an interval of the suffix array and a depth. Squares of something that is itself a power are left out: their runs have a smaller period.
5. located(): the occurrences of a square are its interval's suffixes; those of one period that begin next to each other merge into a run.

No shuffle: each text is looked at within its row, and memory is that of a slice (some 4 MB of texts, or one longer text) times the logarithm of its
longest repeat.

Defined cases: a null or empty text has no words and no runs; words are split at ASCII white space only; a null doc_id counts as the text '' for the
checksum that chooses texts to be changed; repeated rows get equal results; one word many times in a row is one run of period 1; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_rows
from .shingles import mix, odd

#: Words of a run, and times its period that a run is long, at least.
LEAST, TIMES = 6, 4


def changed(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of its n words each word of a text becomes: one text in ten, by the checksum of its doc_id, ends in a repeated passage. None: all stay."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g, at = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


class Text:
    """A string of numbers whose last one occurs nowhere else in it."""

    def __init__(self, s: np.ndarray):
        self.n, width = len(s), 1
        self.names = [np.unique(s, return_inverse=True)[1].astype(np.int32)]
        while (last := self.names[-1]).max() + 1 < self.n:
            after = np.zeros(self.n, np.int64)
            after[:-width] = last[width:] + np.int64(1)
            self.names.append(np.unique(last * np.int64(self.n + 1) + after, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.rank = self.names.pop()  # of each suffix
        self.suffix = np.empty(self.n, np.int32)
        self.suffix[self.rank] = np.arange(self.n, dtype=np.int32)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the strings from the different places i and j are equal."""
        k = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            k += (self.names[level][i + k] == self.names[level][j + k]).astype(np.int64) << level
        return k

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the strings up to and with the different places i and j are equal, backwards; -1 is before the string."""
        k = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            a, b = i - k - (1 << level) + 1, j - k - (1 << level) + 1
            inside = (a >= 0) & (b >= 0)
            k += (inside & (self.names[level][np.maximum(a, 0)] == self.names[level][np.maximum(b, 0)])).astype(np.int64) << level
        return k


def least_of(x: np.ndarray) -> list[np.ndarray]:
    """The least of the 1, 2, 4, ... numbers from each place on."""
    out, width = [x], 1
    while 2 * width <= len(x):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def back_while(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first place of the numbers before each `at` that are, up to it, all at least `least`."""
    at = at.astype(np.int64)
    for level in range(len(table) - 1, -1, -1):
        to = at - (1 << level)
        at = np.where((to >= 0) & (table[level][np.clip(to, 0, len(table[level]) - 1)] >= least), to, at)
    return at


def on_while(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The place after the last of the numbers from each `at` on that are all at least `least`."""
    at, n = at.astype(np.int64), len(table[0])
    for level in range(len(table) - 1, -1, -1):
        fits = at + (1 << level) <= n
        at = np.where(fits & (table[level][np.minimum(at, len(table[level]) - 1)] >= least), at + (1 << level), at)
    return at


def blocks(text: Text) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end of the last."""
    table, own = least_of(text.suffix), text.suffix[text.rank] + 1
    longest = np.zeros(text.n, np.int64)
    for neighbour in (back_while(table, text.rank, own) - 1, on_while(table, text.rank + 1, own)):  # with an earlier start
        there = np.flatnonzero((neighbour >= 0) & (neighbour < text.n))
        longest[there] = np.maximum(longest[there], text.ahead(there, text.suffix[neighbour[there]]))
    steps, starts, at = np.maximum(longest, 1).tolist(), [], 0
    while at < text.n:
        starts.append(at)
        at += steps[at]
    return np.array([*starts, text.n])


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For row numbers repeated by their counts: the row, and the number within it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares that cover the leftmost occurrence of every square."""
    ends = blocks(text)
    size, symbol = np.diff(ends), text.names[0] if text.names else text.rank
    found = []
    for border, reach, back in ((ends[1:], size, True), (ends[:-1], size + np.append(size[1:], 0), False)):
        row, k = _each(reach)
        k, h = k + 1, border[row]
        q = h - k if back else h + k
        ok = (h > 0) & (h < text.n) & (q > 0) & (q < text.n)
        k, h, q = k[ok], h[ok], q[ok]
        ok = (symbol[h] == symbol[q]) | (symbol[h - 1] == symbol[q - 1])
        k, h, q = k[ok], h[ok], q[ok]
        k1, k2 = text.ahead(h, q), text.behind(h - 1, q - 1)
        ok = k1 + k2 >= k
        start = np.minimum(h, q) - np.minimum(k2, k - 1)
        found.append((np.minimum(start, np.minimum(h, q) + k1 - k)[ok], k[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _primes(k: int) -> list[int]:
    out, p = [], 2
    while p * p <= k:
        if k % p == 0:
            out.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return out + [k] * (k > 1)


def primitive(text: Text, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k symbols from start are no power of something shorter; they stand there twice in a row."""
    out = np.ones(len(k), bool)
    different, at = np.unique(k, return_inverse=True)
    primes = [_primes(x) for x in different.tolist()]
    for depth in range(max(map(len, primes), default=0)):
        divisor = np.array([p[depth] if depth < len(p) else 0 for p in primes])[at]
        rows = np.flatnonzero(divisor)
        d = k[rows] // divisor[rows]
        out[rows] &= text.ahead(start[rows], start[rows] + d) < 2 * k[rows] - d
    return out


def vocabulary(text: Text, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, half length) of all squares of primitive halves: the interval of the suffix array whose suffixes begin with the square."""
    first = start - text.behind(start - 1, start + k - 1)
    end = start + k + text.ahead(start, start + k)
    some = np.unique(np.stack([first, end, k], 1), axis=0)
    first, end, k = some[primitive(text, some[:, 0], some[:, 2])].T
    row, step = _each(np.minimum(k, end - first - 2 * k + 1))  # rotations, each by the suffix link of the one before
    at, k = text.rank[first[row] + step], k[row]
    common = np.zeros(text.n, np.int64)
    common[1:] = text.ahead(text.suffix[1:], text.suffix[:-1])
    table = least_of(common)
    low, high = back_while(table, at + 1, 2 * k) - 1, on_while(table, at + 1, 2 * k)
    return tuple(np.unique(np.stack([np.maximum(low, 0), high, k], 1), axis=0).T)


def located(text: Text, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that the squares' occurrences make, by period and start."""
    row, step = _each(high - low)
    start, k = text.suffix[low[row] + step].astype(np.int64), k[row]
    order = np.lexsort((start, k))
    start, k = start[order], k[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1)
    begins = np.flatnonzero(new)
    last = np.append(begins[1:], len(k)) - 1 if len(k) else begins
    return start[begins], start[last] + 2 * k[begins], k[begins]


def stretches(ids: np.ndarray, doc: np.ndarray, gram: int, weights: np.ndarray = odd(17, 11)) -> np.ndarray:
    """Of the words of all texts: whether they are in a window of `gram` words that occurs again in its text."""
    inside, n = np.zeros(len(ids), bool), len(ids) - gram + 1
    if n < 1:
        return inside
    h = doc[:n].astype(np.uint64) * weights[16]
    for i in range(gram):
        h += mix(ids[i : n + i].astype(np.uint64)) * weights[i % 16]
    h = mix(h)
    whole = doc[:n] == doc[gram - 1 :]
    h, at = h[whole], np.flatnonzero(whole)
    s = np.sort(h)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if len(again):
        place = np.minimum(np.searchsorted(again, h), len(again) - 1)
        at = at[again[place] == h]
        for i in range(gram):
            inside[at + i] = True
    return inside


def runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of all texts, by start and period. ids: the words' numbers; doc: each word's text, in order."""
    at = np.flatnonzero(stretches(ids, doc, max(1, times - 1)))
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    number = np.cumsum(new) - 1
    place = np.arange(len(at)) + number  # after each stretch stands a symbol of its own
    string = np.empty(len(at) + number[-1] + 1, np.int64)
    string[:] = np.arange(len(string)) + int(ids.max()) + 1
    string[place] = ids[at]
    back = np.full(len(string), -1, np.int64)
    back[place] = at
    text = Text(string)
    start, end, k = located(text, *vocabulary(text, *covering(text)))
    long = end - start >= np.maximum(least, times * k)
    start, length, k = back[start[long]], (end - start)[long], k[long]
    order = np.lexsort((k, start))
    return start[order], (start + length)[order], k[order]


def described(doc_ids: list[int | None], texts: list[str], change: bool = True, least: int = LEAST, times: int = TIMES) -> dict[str, list]:
    """The columns of collapsed()."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for k, (doc_id, n) in enumerate(zip(doc_ids, sizes.tolist())):
        if change and (to := changed(doc_id, n)) is not None:
            own = words[k]
            words[k] = [own[i] for i in to.tolist()]
            ids[first[k] : first[k] + n] = ids[first[k] + to]
    start, end, period = runs(ids, np.repeat(np.arange(len(words)), sizes), least, times) if len(ids) else (np.zeros(0, np.int64),) * 3
    ends = np.searchsorted(start, np.append(first, len(ids)))
    out: dict[str, list] = {"runs": [], "collapsed": []}
    for k, ws in enumerate(words):
        mine = slice(ends[k], ends[k + 1])
        found = list(zip((start[mine] - first[k]).tolist(), (end[mine] - start[mine]).tolist(), period[mine].tolist()))
        if found:
            keep = np.ones(len(ws), bool)
            for a, n, q in found:
                keep[a + q : a + n] = False
            ws = [w for w, stays in zip(ws, keep.tolist()) if stays]
        out["runs"].append(found)
        out["collapsed"].append(b" ".join(ws))
    return out


def _rows(df: DataFrame, columns, schema: str, change: bool, least: int, times: int) -> DataFrame:
    def make():
        def each(batch):
            ids = batch.column(0).to_pylist()
            return columns(ids, described(ids, batch.column(1).to_pylist(), change, least, times))

        return each

    return map_rows(id_text(df), make, schema, by=1)


def collapsed(df: DataFrame, change: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, text, starts, lengths, periods): each text without the words of its runs after their first periods, its words joined by one space; and its runs
    by start, then period. change: one text in ten first gets a repeated passage, as changed() says."""

    def columns(ids, got):
        parts = {name: [[r[i] for r in x] for x in got["runs"]] for i, name in enumerate(("starts", "lengths", "periods"))}
        return {"doc_id": ids, "text": [x.decode("utf-8", "surrogatepass") for x in got["collapsed"]], **parts}

    return _rows(df, columns, "doc_id long, text string, starts array<long>, lengths array<long>, periods array<long>", change, least, times)


def digests(df: DataFrame, change: bool = True, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run (of equals the one of least start, then least
    period), and the digests of all runs and of the collapsed text."""

    def columns(ids, got):
        best = [max(r, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None)) for r in got["runs"]]
        return {
            "doc_id": ids, "n_runs": list(map(len, got["runs"])), "start": [b[0] for b in best], "length": [b[1] for b in best], "period": [b[2] for b in best],
            "exponent_milli": [None if b[2] is None else 1000 * b[1] // b[2] for b in best],
            "runs_sha256": [hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in r).encode()).hexdigest() for r in got["runs"]],
            "collapsed_sha256": [hashlib.sha256(x).hexdigest() for x in got["collapsed"]],
        }

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _rows(df, columns, schema, change, least, times)
