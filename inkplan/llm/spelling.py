"""Spelling variants: words that one inserted, deleted or replaced character tells apart, found through forward and reversed sorted dictionaries.

Of two such words, let m be the length of the shorter and x the length of their longest common beginning. One edit leaves a half intact: where
x reaches the middle of the shorter one, both share the first m // 2 characters and lie in one block of the dictionary; where it doesn't, both
share the last m - m // 2 and lie in one block of the dictionary of reversed words. Each word is entered as the shorter one (m is its length)
and as the longer one (m is one less).

1. entries(): the dictionaries' rows, with the shared beginning (head) and end (tail) that make their block.
2. divided(): blocks of more than MOST rows are divided in the same way: what head and tail leave open has two halves, of which one edit leaves
   one intact, so each row goes on to one block with a longer head and to one with a longer tail, until blocks are small or only one character is
   open. x says in which of the two a pair is met, so each is met exactly once. Blocks are counted by partial sums; no block is gathered for that.
3. scanned(): each partition is sorted by block and word, and scanned with neighbours at growing distance, so memory is that of a batch and one
   block, and pairs don't leave the scan: a word's row has the number of its near words in the block and the best of them.
4. forms(): rows of a word are added up, its form is chosen, and forms are followed by doubling to the last one.

Defined cases: null and empty texts, and texts without letters, have no words; a null doc_id counts as the text ''; repeated rows count each; of
equally frequent near words the first in code-point order is the form; words of any length are compared whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, id_text, let_go, stored

#: Code points and occurrences that a word has at least.
SHORTEST, LEAST = 7, 2
#: How many times as frequent as a word its form is at least.
TIMES = 10
#: Rows of a block that is scanned as it is.
MOST = 256
#: Characters up to which words lie side by side in one table of code points.
WIDE = 64


def words(df: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of all words with so many code points and occurrences. Of one text in 31 (by the checksum of doc_id and word) a word loses
    a character, which makes variants to find."""
    runs = id_text(df).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0))).alias("run"))
    lower = runs.select("doc", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    summed = lower.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    cut = F.expr("if(h % 31 = 0, concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2)), run)")
    found = summed.select(cut.alias("word")).where(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _block(m: Column, a: Column, b: Column) -> list[Column]:
    """Of words entered with length m: a shared characters at their beginning (head) and b at their end (tail)."""
    word = F.col("word")
    return [m.alias("m"), a.alias("a"), b.alias("b"), word.substr(F.lit(1), a).alias("head"), F.when(b > 0, F.right(word, b)).otherwise("").alias("tail")]


BLOCK = ["m", "a", "b", "head", "tail"]


def entries(found: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, n, m, a, b, head, tail): the rows of both dictionaries."""
    size = F.length("word")
    roles = found.select("word", "n", F.explode(F.when(size > shortest, F.array(size, size - 1)).otherwise(F.array(size))).alias("m"))
    return _halves(roles.select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the block with the longer head and in the one with the longer tail."""
    middle = F.col("a") + F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    ends = F.explode(F.array(F.struct(middle.alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("m") - middle).alias("b"))))
    return rows.select("word", "n", "m", ends.alias("e")).select("word", "n", *_block(F.col("m"), F.col("e.a"), F.col("e.b")))


def divided(spark: SparkSession, rows: DataFrame, most: int = MOST) -> Iterator[DataFrame]:
    """The rows of blocks of at most `most` rows, and of those that can't be divided, level by level. What no small block holds goes on, written
    to the shared folder."""
    while True:
        rows = stored(spark, rows, "dictionary")
        large = rows.where(F.col("m") - F.col("a") - F.col("b") > 1).groupBy(*BLOCK).agg(F.count("*").alias("rows")).where(F.col("rows") > most)
        large = stored(spark, large.select(*BLOCK, F.lit(True).alias("large")), "blocks")
        if large.isEmpty():
            yield rows
            return
        marked = rows.join(large, BLOCK, "left")
        yield marked.where("large is null").select(*rows.columns)
        rows = _halves(marked.where("large").select("word", "n", "m", "a", "b"))


def near_tables(entries: list[str], c: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether entries i and j, whose lengths differ by one at most, are one edit apart, and the length of their common beginning. c: code points, with a
    column of zeros at the end."""
    longer = np.where(size[i] > size[j], i, j)
    shorter = i + j - longer
    s, t = c[shorter], c[longer]
    other = s != t
    x = other.argmax(1)
    same = other.sum(1) == 1
    moved = s[:, :-1] != t[:, 1:]
    moved &= np.arange(moved.shape[1]) >= x[:, None]
    return np.where(size[i] == size[j], same, ~moved.any(1)), x


def near_strings(entries: list[str], c: None, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As near_tables(), by strings: for long words."""
    near, x = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
        s, t = sorted((entries[p], entries[q]), key=len)
        low, high = 0, len(s)
        while low < high:  # the longest common beginning
            mid = (low + high + 1) // 2
            low, high = (mid, high) if s[:mid] == t[:mid] else (low, mid - 1)
        x[k], near[k] = low, s[low + (len(s) == len(t)) :] == t[low + 1 :]
    return near, x


def scan(words: list[str], n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, block: np.ndarray) -> dict[str, list | np.ndarray] | None:
    """Rows sorted by block: of each word with near words in its block, their number and the best. Pairs whose common beginning belongs to
    another block are left to that."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    table = None
    if (wide := int(size.max())) <= WIDE:
        table = np.zeros((len(words), wide + 2), np.uint32)
        table[:, :wide] = np.array(words, f"<U{wide}").view(np.uint32).reshape(len(words), wide)
    near = near_strings if table is None else near_tables
    left, right, i, d = [], [], np.arange(len(words)), 1
    while len(i := i[i + d < len(words)]) and len(i := i[block[i] == block[i + d]]):
        j = i + d
        pair = np.minimum(size[i], size[j]) == m[i]
        for k in np.array_split(np.flatnonzero(pair), max(1, -(-int(pair.sum()) // 50_000))):
            ok, x = near(words, table, size, i[k], j[k])
            ok &= (x >= a[i[k]]) & ((b[i[k]] == 0) | (x < m[i[k]] - b[i[k]]))
            left.append(i[k][ok])
            right.append(j[k][ok])
        d += 1
    if not left or not len(p := np.concatenate(left)):
        return None
    q = np.concatenate(right)
    p, q = np.concatenate([p, q]), np.concatenate([q, p])
    rank = np.argsort(np.argsort(np.array(words)))  # code-point order
    order = np.lexsort((rank[q], -n[q], p))
    p, q = p[order], q[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return {"word": [words[k] for k in p[first].tolist()], "n_near": np.diff(np.append(first, len(p))), "best_n": n[q[first]], "best": [words[k] for k in q[first].tolist()]}


def scanned(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): parts of each word's near words, by block."""
    schema = "word string, n_near long, best_n long, best string"
    oriented = F.when(F.col("b") > 0, F.reverse("word")).otherwise(F.col("word"))  # the reversed dictionary's blocks share their beginnings too
    placed = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, oriented).select("word", "n", *BLOCK)

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows of whole blocks, and the number of each row's block."""
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None or not kept.num_rows else pa.concat_tables([kept, pa.Table.from_batches([batch])]).combine_chunks()
            number = numbered(table)
            if len(number):
                end = int(np.searchsorted(number, number[-1]))  # the last block may go on
                kept = table.slice(end)
                if end:
                    yield table.slice(0, end), number[:end]
        if kept is not None and kept.num_rows:
            yield kept, numbered(kept)

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for name in BLOCK:
            got = table.column(name).combine_chunks()
            got = got.dictionary_encode().indices if pa.types.is_string(got.type) else got
            got = got.to_numpy(zero_copy_only=False)
            new[1:] |= got[1:] != got[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        target = arrow_schema(schema)
        for table, number in complete(batches):
            col = {k: table.column(k).to_numpy() for k in ("n", "m", "a", "b")}
            names = table.column("word").to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            ends = np.append(starts[1:], len(number))
            long = np.maximum.reduceat(np.fromiter(map(len, names), np.int64, len(names)), starts) > WIDE
            own = np.repeat(long, ends - starts)
            for part in [np.flatnonzero(~own), *(np.arange(starts[k], ends[k]) for k in np.flatnonzero(long))]:
                if len(part) > 1:
                    got = scan([names[k] for k in part.tolist()], *(col[k][part] for k in ("n", "m", "a", "b")), number[part])
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in target], schema=target)

    return placed.mapInArrow(run, schema)


def forms(spark: SparkSession, df: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    found = stored(spark, words(df), "words")
    parts = None
    for level in divided(spark, entries(found), most):
        got = scanned(level)
        parts = got if parts is None else parts.unionByName(got)
    best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("first"))
    enough = -F.col("first.less") >= times * F.col("n")
    whole = found.join(best, "word", "left").select(
        "word", F.when(enough, F.col("first.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("first.less")).alias("form_n")
    )
    whole = stored(spark, whole, "forms")
    return whole.join(roots(spark, whole), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(spark: SparkSession, whole: DataFrame) -> DataFrame:
    """(word, root) of words that have a form. A form is several times as frequent as its word, so chains end, and are short; each round
    doubles what has been followed."""
    far = stored(spark, whole.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(spark, far.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        far = new.select("word", "root")
        if new.where("went").isEmpty():
            return far
