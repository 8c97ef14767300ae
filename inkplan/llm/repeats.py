"""Windows of symbols (bytes or words) that occur again: what substring dedup by suffix buckets and by
super-k-mers have in common.

A window's minimiser is the k-mer of least hash in it, the leftmost of equals. Consecutive windows of a text that share a
minimiser's place form one super-k-mer; equal windows have equal minimisers at the same place, so only super-k-mers with the same
minimiser need to meet. Equal windows are found by comparing the symbols themselves; hashes only say who meets whom:

1. once(): rows that repeat a text as a whole are set apart, so one row for each text goes on.
2. describe(): each chunk of texts gives a short row for each super-k-mer: the minimiser's hash and the place. Strings that occur
   again in the chunk are compared there and are one row.
3. resolve(): rows meet by minimiser, in a stream. One that nothing shares holds no repeated window and ends here.
4. packed(): the strings of all others, cut from the texts, travel to the minimiser's bucket.
5. sort_buckets(): a bucket's strings come sorted; equal ones are settled as neighbours, and the windows of different ones are
   sorted. A minimiser with more than HOT strings has a bucket for each of its windows, so that it doesn't fill one task: its
   windows travel one by one, by their hash, and are sorted and compared there in the same way.

A text is known by its doc_id and a key of its own, so that texts without a doc_id, or with the same, each meet their own places only; in
one doc_id, texts are ordered by their keys. Symbols come as 64-bit hashes, of a byte or of a word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, fresh, let_go, map_rows, slices, stored
from .neardup import maybe_in
from .shingles import mix, odd

#: Window starts handled at a time; longer texts are cut there, with the overlap that windows need.
CHUNK = 1 << 19
PLACE_BITS = np.uint64(24)
PLACES = np.uint64((1 << 24) - 1)
#: Strings at one minimiser beyond which its windows have a bucket each.
HOT = 2000
_A, _B, _C = odd(8, 23), odd(8, 29), odd(8, 31)

QUERY, SPAN, STRING, WINDOWS = 0, 1, 2, 3
ROW = "a long, doc long, key long, start long, n int, many boolean, kind int"
NAMES = [p.split()[0] for p in ROW.split(",")]
STRINGS = "a long, doc long, key long, start long, n int, many boolean, packed binary"
#: Strings that a task cuts or settles before it hands them on.
MOST_CUT = 20_000


class Powers:
    """Hashes of all runs of 1, 2, 4, ... symbols, and from them of runs of any length."""

    def __init__(self, h: np.ndarray, longest: int):
        self.of = {1: h}
        size = 1
        while 2 * size <= longest:
            h = h[:-size] * _A[size.bit_length() % 8] + h[size:] if len(h) > size else h[:0]
            h ^= h >> np.uint64(29)
            self.of[2 * size] = h
            size *= 2

    def runs(self, at: np.ndarray | slice, length: int, salt: np.ndarray = _B) -> np.ndarray:
        """Hashes of the runs of `length` symbols from the places `at` (an array or slice(0, n))."""
        total, gone = None, 0
        for size in sorted(self.of, reverse=True):
            while length - gone >= size:
                part = self.of[size][at + gone] if isinstance(at, np.ndarray) else self.of[size][gone : gone + at.stop]
                total = part * salt[0] if total is None else mix(total + part * salt[size.bit_length() % 8])
                gone += size
        return total


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    ahead = np.minimum.accumulate(full.reshape(rows, width), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def super_kmers(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Of texts laid end to end, text i at [starts[i], ends[i]): for each super-k-mer its text, first window, number of
    windows, and the hashes a (minimiser) and b (string)."""
    powers = Powers(h, window)
    n = len(h) - window + 1
    kmers = powers.runs(slice(0, len(h) - k + 1), k)
    key = kmers >> PLACE_BITS << PLACE_BITS
    key |= np.arange(len(key), dtype=np.uint64)
    place = sliding_min(key, window - k + 1) & PLACES
    ok = np.zeros(n + 1, np.int32)
    fits = ends - starts >= window
    np.add.at(ok, starts[fits], 1)
    np.add.at(ok, ends[fits] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(ok[:n]))
    if not len(at):
        empty = np.zeros(0, np.int64)
        return {"text": empty, "first": empty, "n": empty, "a": empty, "b": empty}
    p = place[at]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(new, len(at)))
    first, p = at[new], p[new].astype(np.int64)
    last = first + count - 1
    offset = (p - first).astype(np.uint64)
    # The first and last window overlap, so their hashes and the length say what the whole string is.
    b = mix(powers.runs(first, window, _C) * _A[1] + powers.runs(last, window, _B) * _A[2] + count.astype(np.uint64) * _A[3] + offset * _A[4])
    text = np.searchsorted(starts, first, "right") - 1
    return {"text": text, "first": first, "n": count, "a": mix(kmers[p]).view(np.int64), "b": b.view(np.int64)}


def chunks(docs: np.ndarray, keys: np.ndarray, symbols: Callable[[int], np.ndarray], window: int):
    """Texts in order of their ids and keys, laid end to end up to CHUNK: (hashes, starts, ends, docs, keys, bases)."""
    held, size, rows = [], 0, []
    for i in np.lexsort((keys, docs)):
        h = symbols(i)
        for base in range(0, max(1, len(h) - window + 1), CHUNK):
            part = h[base : base + CHUNK + window - 1]
            if len(part) < window:
                continue
            if size and size + len(part) > CHUNK + window:
                yield np.concatenate(held), *map(np.array, zip(*rows))
                held, size, rows = [], 0, []
            rows.append((size, size + len(part), docs[i], keys[i], base))
            held.append(part)
            size += len(part)
    if held:
        yield np.concatenate(held), *map(np.array, zip(*rows))


def merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows that follow one another in a text, as one."""
    if not len(doc):
        return {"doc": doc, "key": key, "start": start, "n": n}
    order = np.lexsort((start, key, doc))
    doc, key, start, n = doc[order], key[order], start[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + n[:-1])]))
    last = np.append(new[1:], len(doc)) - 1
    return {"doc": doc[new], "key": key[new], "start": start[new], "n": start[last] + n[last] - start[new]}


def _row(kind: int, **columns: np.ndarray) -> dict[str, np.ndarray]:
    n = len(columns["doc"])
    return {"a": np.zeros(n, np.int64), "many": np.zeros(n, bool), "kind": np.full(n, kind, np.int32)} | columns


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) if parts else [] for c in NAMES}


def _batch(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    target = arrow_schema(ROW)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in target], schema=target)


def once(spark: SparkSession, df: DataFrame, id_col: str, copy: str, many: str) -> DataFrame:
    """df with two flags: `copy`, whether another row holds the same text and is the first that does (of the least id_col, which
    has no nulls), and `many`, whether any other row holds it. Texts are compared by SHA-256; only those that may be copies are
    shuffled."""
    total, maybe, number, first, rows = (fresh(df, c) for c in ("_sum", "_maybe", "_number", "_first", "_rows"))
    named = df.withColumn(total, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    counts = named.groupBy(total).agg(F.count("*").alias(rows)).where(F.col(rows) > 1)
    counts = stored(spark, counts.select(total), "copied")
    some = maybe_in(named, counts, (total,), (total,), maybe)
    held = stored(spark, some.where(F.col(maybe)).drop(maybe).withColumn(number, F.monotonically_increasing_id()), "copies")
    firsts = held.groupBy(total).agg(F.min(F.struct(F.col(id_col), F.col(number))).alias(first), F.count("*").alias(rows))
    groups = firsts.select(F.col(f"{first}.{number}").alias(number), (F.col(rows) > 1).alias(many))
    told = held.join(groups, number, "left").withColumn(copy, F.col(many).isNull()).withColumn(many, F.coalesce(many, F.lit(True)))
    names = [F.col(f"`{c}`") for c in df.columns]
    told = stored(spark, told.select(*names, copy, many), "told")
    return some.where(~F.col(maybe)).select(*names, F.lit(False).alias(copy), F.lit(False).alias(many)).union(told)


def same_runs(h: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the length[i] symbols of h from x[i] on are those from y[i] on."""
    out = np.ones(len(x), bool)
    at = 0
    while at < len(x):  # in pieces of some million symbols
        end = max(at + 1, int(np.searchsorted(np.cumsum(length[at:]), 1 << 22, "right")) + at)
        n = length[at:end]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[at:end] = np.logical_and.reduceat(h[np.repeat(x[at:end], n) + step] == h[np.repeat(y[at:end], n) + step], begin)
        at = end
    return out


def local(h: np.ndarray, s: dict[str, np.ndarray], doc: np.ndarray, key: np.ndarray, start: np.ndarray, copied: np.ndarray, window: int, keep_first: bool) -> list[dict[str, np.ndarray]]:
    """The super-k-mers s of a chunk h, in document order, to one QUERY row for each string, and SPANs for the others of each."""
    a, n = s["a"], s["n"]
    if not len(a):
        return []
    order = np.lexsort((s["b"], a))
    x, y = a[order], s["b"][order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (n[order[1:]] != n[order[:-1]])])
    like = np.flatnonzero(~new)
    new[like] = ~same_runs(h, s["first"][order[like]], s["first"][order[like - 1]], n[order[like]].astype(np.int64) + window - 1)
    first, at = order[new], np.flatnonzero(new)
    times = np.diff(np.append(at, len(x)))
    many = (times > 1) | np.logical_or.reduceat(copied[order], at)
    out = [_row(QUERY, a=a[first], doc=doc[first], key=key[first], start=start[first], n=n[first], many=many)]
    again = order[~new] if keep_first else order[np.repeat(times > 1, times)]
    some = merged(doc[again], key[again], start[again], n[again])
    out.append(_row(SPAN, **some, a=mix((some["doc"] * 31 + some["key"] + some["start"]).view(np.uint64)).view(np.int64)))
    return out


def describe(df: DataFrame, symbols: Callable[[str], np.ndarray], window: int, k: int, keep_first: bool) -> DataFrame:
    """Step 2. df: (doc_id, text, key, many), each text once. keep_first: the earliest occurrence of a window isn't itself repeated."""

    def make():
        def each(batch):
            docs, texts, keys, many = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            out, copied = [], {(int(docs[i]), int(keys[i])) for i in np.flatnonzero(many)}
            for h, starts, ends, ids, own, bases in chunks(docs, keys, lambda i: symbols(texts[int(i)].as_py()), window):
                s = super_kmers(h, starts, ends, window, k)
                twice = np.array([(int(d), int(o)) in copied for d, o in zip(ids, own)], bool) if copied else np.zeros(len(ids), bool)
                out += local(h, s, ids[s["text"]], own[s["text"]], bases[s["text"]] + s["first"] - starts[s["text"]], twice[s["text"]], window, keep_first)
            return _joined(out)

        return each

    return map_rows(df.select("doc_id", "text", "key", "many"), make, ROW)


def resolve(rows: DataFrame) -> DataFrame:
    """Step 3. SPANs pass; QUERY rows meet by minimiser, sorted, in a stream: those that share theirs become STRINGs, or WINDOWS if there
    are more than HOT of them. No more than HOT rows of a minimiser are held."""
    sorted_rows = rows.repartition("a").sortWithinPartitions("a")

    def run(batches):
        let_go()
        held: list[dict[str, np.ndarray]] = []
        size, hot = 0, None

        def settled(t):
            a, query = t["a"], t["kind"] == QUERY
            q = {c: v[query] for c, v in t.items()}
            new = np.flatnonzero(np.concatenate([[True], q["a"][1:] != q["a"][:-1]])) if query.any() else np.zeros(0, np.int64)
            number = np.repeat(np.diff(np.append(new, len(q["a"]))), np.diff(np.append(new, len(q["a"]))))
            shared = number > 1
            q = {c: v[shared] for c, v in q.items()} | {"kind": np.where(number[shared] > HOT, WINDOWS, STRING).astype(np.int32)}
            return _batch(_joined([q, {c: v[~query] for c, v in t.items()}]))

        def dealt(t):
            return _batch(t | {"kind": np.where(t["kind"] == QUERY, WINDOWS, t["kind"]).astype(np.int32)})

        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES}
            if hot is not None and len(t["a"]):
                more = int(np.searchsorted(t["a"], hot, "right"))
                if more:
                    yield dealt({c: v[:more] for c, v in t.items()})
                    t = {c: v[more:] for c, v in t.items()}
            if not len(t["a"]):
                continue
            hot, cut = None, int(np.searchsorted(t["a"], t["a"][-1]))
            if held and t["a"][0] != held[-1]["a"][-1] or cut:
                yield settled(_joined([*held, {c: v[:cut] for c, v in t.items()}]))
                held, size = [], 0
            held.append({c: v[cut:] for c, v in t.items()})
            size += len(held[-1]["a"])
            if size > HOT + 1:
                hot = t["a"][-1]
                yield dealt(_joined(held))
                held, size = [], 0
        if held:
            yield settled(_joined(held))

    return sorted_rows.mapInArrow(run, ROW)


def by_document(rows: DataFrame, kinds: tuple[int, ...], columns: tuple[str, ...]) -> DataFrame:
    """One row for each text, with a list of its rows: as many as the text has windows at most."""
    return rows.where(F.col("kind").isin(*kinds)).groupBy("doc", F.col("key").alias("doc_key")).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def packed(docs: DataFrame, found: DataFrame, symbols: Callable[[str], np.ndarray], cut: Callable, window: int) -> DataFrame:
    """Step 4. (a, doc, key, start, n, many, packed): the strings themselves; a WINDOWS row gives one for each of its windows, with
    the window's hash for a."""
    wanted = by_document(found, (STRING, WINDOWS), ("a", "start", "n", "many", "kind"))
    met = maybe_in(docs, found.where(F.col("kind").isin(STRING, WINDOWS)).select("doc", "key"), ("doc_id", "key"), ("doc", "key"))
    met = met.join(wanted, (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("doc_key"))).select("doc_id", "text", "rows", "key")

    def run(batches):
        let_go()
        target = arrow_schema(STRINGS)
        columns: list[list] = [[] for _ in target]

        def give():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)
            for c in columns:
                c.clear()
            return made

        def put(*values):
            for c, v in zip(columns, values):
                c.append(v)

        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, rows, key = (batch.column(k)[i].as_py() for k in range(4))
                piece, powers = cut(text), None
                for r in rows:
                    first, n = r["start"], r["n"]
                    if r["kind"] == STRING:
                        put(r["a"], doc, key, first, n, r["many"], piece(first, first + n + window - 1))
                        continue
                    powers = powers or Powers(symbols(text), window)
                    dealt = mix(powers.runs(np.arange(first, first + n), window, _B)).view(np.int64)
                    for k, a in enumerate(dealt.tolist()):
                        put(a, doc, key, first + k, 1, r["many"], piece(first + k, first + k + window))
                    if len(columns[0]) > MOST_CUT:
                        yield give()
                if len(columns[0]) > MOST_CUT:
                    yield give()
        if columns[0]:
            yield give()

    return met.mapInArrow(run, STRINGS)


def sort_buckets(strings: DataFrame, repeated: Callable, most: int, keep_first: bool) -> DataFrame:
    """Step 5. SPANs of the windows that are repeated in each bucket. Of equal strings, which come one after the other, the first alone
    is held; the different strings of whole minimisers, as many as make up `most` bytes, are sorted by
    repeated(strings, n, many, order), which gives a bool for each window, string after string."""
    rows = strings.select("a", "packed", "doc", "key", "start", "n", "many").repartition("a").sortWithinPartitions("a", "packed", "doc", "key", "start")

    def run(batches):
        let_go()
        held: list[list] = []
        again: list[tuple] = []
        size = 0

        def give():
            parts = []
            if again:
                doc, key, start, n = (np.array(c, np.int64) for c in zip(*again))
                parts.append(merged(doc, key, start, n))
            if held:
                a = np.array([r[0] for r in held], np.int64)
                _, group, number = np.unique(a, return_inverse=True, return_counts=True)
                lone = number[group] == 1
                doc, key, start, n = (np.array([r[k] for r in held], np.int64) for k in (2, 3, 4, 5))
                many = np.array([r[6] for r in held], bool)
                if not keep_first and (whole := np.flatnonzero(lone & many)).size:
                    parts.append(merged(doc[whole], key[whole], start[whole], n[whole]))
                if (i := np.flatnonzero(~lone)).size:
                    hit = repeated([held[k][1] for k in i], n[i], many[i], np.lexsort((start[i], key[i], doc[i])).argsort())
                    at = np.repeat(i, n[i])
                    within = np.arange(len(at)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
                    parts.append(merged(doc[at[hit]], key[at[hit]], (start[at] + within)[hit], np.ones(int(hit.sum()), np.int64)))
            return _batch(_joined([_row(SPAN, **p) for p in parts]))

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if held and held[-1][0] == r[0] and held[-1][1] == r[1]:
                    again.append(r[2:6])
                    held[-1][6] = True
                    if len(again) > MOST_CUT:
                        parts = [np.array(c, np.int64) for c in zip(*again)]
                        yield _batch(_row(SPAN, **merged(*parts)))
                        again.clear()
                    continue
                if held and size >= most and held[-1][0] != r[0]:
                    yield give()
                    held, size = [], 0
                    again.clear()
                held.append(list(r))
                size += len(r[1])
        if held:
            yield give()

    return rows.mapInArrow(run, ROW)


def spans(spark: SparkSession, docs: DataFrame, symbols: Callable, cut: Callable, repeated: Callable, window: int, k: int, keep_first: bool, most: int) -> DataFrame:
    """(doc, key, start, n): n consecutive repeated windows from a place of a text. docs: (doc_id, text, key, many), each text once."""
    found = stored(spark, resolve(describe(docs, symbols, window, k, keep_first)), "found")
    sorted_ = sort_buckets(packed(docs, found, symbols, cut, window), repeated, most, keep_first)
    columns = ("doc", "key", "start", "n", "kind")
    return stored(spark, found.where(F.col("kind") == SPAN).select(*columns).union(sorted_.select(*columns)), "spans")


def without(docs: DataFrame, found: DataFrame, whole: Column, apply: Callable, window: int, schema: str) -> DataFrame:
    """apply(text, ranges) for each row of docs (with the flags of once()): ranges are the sorted, disjoint covered [first, end) of its
    text; None where `whole` says that all of it is covered. Only documents that may have some are shuffled."""
    listed = by_document(found, (SPAN,), ("start", "n"))
    some = maybe_in(docs.withColumn("whole", whole), found.select("doc", "key"), ("doc_id", "key"), ("doc", "key"), "maybe")
    none = some.where("whole or not maybe").select("doc_id", "text", F.array().cast("array<struct<start:bigint,n:int>>").alias("rows"), "whole")
    met = some.where("maybe and not whole").join(listed, (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("doc_key")), "left").select("doc_id", "text", "rows", "whole")

    def run(batches):
        let_go()
        target = arrow_schema(schema)
        for batch in slices(batches):
            out = []
            for doc, text, rows, all_ in zip(*(batch.column(k).to_pylist() for k in range(4))):
                out.append((doc, *apply(text, None if all_ else covered(rows or [], window))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return met.union(none).mapInArrow(run, schema)


def covered(rows: list[dict], window: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["start"] + r["n"] + window - 1) for r in rows):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
