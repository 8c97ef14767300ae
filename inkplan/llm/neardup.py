"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate links and what these leave open.

A document's set of five-word shingles is hashed once and dealt into BINS bins, the least hash of each bin is its signature,
and an empty bin borrows from another by its own fixed random sequence of bins (optimal densification). Bands of ROWS signature
values name buckets. Documents with equal sets (by SHA-256) become one class first, so copies never meet in buckets. In a bucket, each
class is linked to the least and to the greatest one only: links grow with the rows of a bucket, not with its pairs. Links with a close
enough signature are confirmed on the full shingle sets, and the confirmed ones joined to components.

Two rows of a bucket may be alike though neither is like its ends. So where a bucket's rows aren't in one component after that, its
other rows meet once more, in blocks, with their full sets: each is compared with those that it isn't joined to yet and whose size
allows it. Only the links found leave the block; no pair is emitted, and a pair that shares several buckets is compared in the first.

A pair at similarity 0.85 shares no bucket with probability (1 - 0.85^4)^32 = 6e-11, at 0.8 with 5e-8.

Defined cases: null or empty text, or one without words: an empty set, linked with nothing; fewer than five words: the whole
sequence is the one shingle; rows without a doc_id, or with the same, are linked by their texts alone; a null doc_id comes after all others, so
component_id is null only where no row of the component has a doc_id; of each component exactly one row is kept, of rows with its least doc_id the one with the
least text_key(); other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, arrow_schema, fresh, let_go, map_rows, slices, stored, text_key, texts, unkeyed
from .graphs import components
from .shingles import lower_words, mix, odd, shingle_set

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
SHINGLE = 5
#: The signature's share of equal values may fall short of the similarity by so many standard deviations.
DEVIATIONS = 5
#: Bits of a filter over keys: at least LEAST_BITS (1 MB), KEY_BITS for each key, at most MOST_BITS (32 MB, which may be broadcast). Beyond MOST_KEYS, where
#: the largest filter would let every fifth stranger through, keys are joined.
LEAST_BITS, KEY_BITS, MOST_BITS = 1 << 23, 16, 1 << 28
MOST_KEYS = MOST_BITS // 4
#: Rows of a bucket compared with one another in one piece, and the shingles of these.
BLOCK, ITEMS = 2000, 2_000_000

_EDGES = (np.arange(BINS + 1, dtype=np.float64) * (2.0**64 / BINS)).astype(object)
EDGES = np.array([int(x) for x in _EDGES[:-1]], np.uint64)
PROBES = np.random.default_rng(11).integers(0, BINS, (BINS, 1024))
WEIGHTS = odd(ROWS, 13)
BAND_SALT = odd(BANDS, 17)


def signature(s: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set of 64-bit hashes."""
    first = np.searchsorted(s, EDGES)
    full = np.append(first[1:], len(s)) > first
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for width in (32, PROBES.shape[1]):
        if not len(empty):
            break
        hit = full[PROBES[empty, :width]]
        at = hit.argmax(1)
        found = hit[np.arange(len(empty)), at]
        source[empty[found]] = PROBES[empty[found], at[found]]
        empty = empty[~found]
    if len(empty):  # no probe met a full bin: the next full one
        filled = np.flatnonzero(full)
        source[empty] = filled[np.searchsorted(filled, empty) % len(filled)]
    return s[first[source]]


def bands(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(BANDS, ROWS) * WEIGHTS).sum(1) + BAND_SALT).view(np.int64)


def signatures(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n, set_a, set_b, buckets, sig): set_a and set_b are 128 bits of the SHA-256 of the whole set."""

    def make():
        def each(batch):
            out = {k: [] for k in ("n", "set_a", "set_b", "buckets", "sig")}
            for text in batch.column(1).to_pylist():
                s = shingle_set(lower_words(text), shingle)
                out["n"].append(len(s))
                if not len(s):
                    for k in ("set_a", "set_b", "buckets", "sig"):
                        out[k].append(None)
                    continue
                sig = signature(s)
                whole = hashlib.sha256(s.tobytes()).digest()
                out["set_a"].append(int.from_bytes(whole[:8], "little", signed=True))
                out["set_b"].append(int.from_bytes(whole[8:16], "little", signed=True))
                out["buckets"].append(bands(sig))
                out["sig"].append(sig.astype(np.uint16).tobytes())
            return {"doc_id": batch.column(0), "key": batch.column(2), **out}

        return each

    return map_rows(texts(df), make, "doc_id long, key long, n long, set_a long, set_b long, buckets array<long>, sig binary")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(node, bucket, lo, hi, size) from nodes (node, buckets): the rows of each bucket of two or more, with its least, greatest and number."""
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    return rows.join(ends, "bucket").select("node", "bucket", "lo", "hi", "size")


def star_links(met: DataFrame) -> DataFrame:
    """Distinct (a, b, hub), a < b, from bucket_rows(): each bucket's rows with its least and its greatest, which is the hub."""
    pairs = met.select(F.explode(F.array(F.struct("lo", "node", F.col("lo").alias("hub")), F.struct(F.col("hi").alias("lo"), "node", F.col("hi").alias("hub")))).alias("p"))
    pairs = pairs.select(F.least("p.lo", "p.node").alias("a"), F.greatest("p.lo", "p.node").alias("b"), "p.hub").where("a < b")
    return pairs.groupBy("a", "b").agg(F.min("hub").alias("hub"))


def least_shared(percent: int, n: np.ndarray) -> np.ndarray:
    """Equal signature values that a pair at the similarity has at least; n: shingles of the smaller set. With few shingles, few bins
    hold values of their own, so the share of equal values varies as that of so many draws."""
    p = percent / 100
    return BINS * (p - DEVIATIONS * np.sqrt(p * (1 - p) * (1 / BINS + 1 / np.maximum(n, 1))))


def close(links: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The links (a, b, hub) whose sizes and signatures allow the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    met = links.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def make():
        def each(batch):
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BINS) for k in (3, 4))
            keep = (x == y).sum(1) >= least_shared(percent, batch.column(5).to_numpy())
            return {c: batch.column(c).to_numpy()[keep] for c in ("a", "b", "hub")}

        return each

    return map_rows(met.select("a", "b", "hub", "sig_a", "sig_b", F.least("n_a", "n_b").alias("n")), make, "a long, b long, hub long")


def filter_bits(keys: int) -> int:
    bits = LEAST_BITS
    while bits < min(KEY_BITS * keys, MOST_BITS):
        bits *= 2
    return bits


def maybe_in(df: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("doc_id",), others: tuple[str, ...] = ("doc_id",), flag: str | None = None) -> DataFrame:
    """Rows of df whose `columns` may be in `others` of ids (flag: all rows, with that as a column of this name): a bit filter, sized by the
    number of ids and bounded, is broadcast, so that df is neither shuffled nor sorted. Rows let through in error do no harm. For more than MOST_KEYS ids
    the rows are joined with them, which shuffles both by key. Null keys are in no ids."""
    keys = ids.agg(F.approx_count_distinct(F.xxhash64(*others))).first()[0]
    if keys > MOST_KEYS:
        return joined_in(df, ids, columns, others, flag)
    slot = lambda of: F.pmod(F.xxhash64(*of), F.lit(filter_bits(keys)))
    bits = ids.select(slot(others).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("number"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    number, place = fresh(df, "number"), fresh(df, "place")
    bits = F.broadcast(bits.withColumnRenamed("number", number).withColumnRenamed("bits", fresh(df, "bits")))
    held = fresh(df, "bits")
    out = df.withColumn(place, F.bitmap_bit_position(slot(columns))).withColumn(number, F.bitmap_bucket_number(slot(columns)))
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))
    out = out.join(bits, number, "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*names, hit.alias(flag)) if flag else out.where(hit).select(*names)


def joined_in(df: DataFrame, ids: DataFrame, columns: tuple[str, ...], others: tuple[str, ...], flag: str | None) -> DataFrame:
    """As maybe_in(), by a join."""
    names = [fresh(df, f"_key{k}") for k in range(len(others))]
    hit = fresh(df, "_hit")
    keys = ids.select(*[F.col(c).alias(n) for c, n in zip(others, names)]).distinct().withColumn(hit, F.lit(True))
    on = [df[f"`{c}`"] == keys[n] for c, n in zip(columns, names)]
    if flag is None:
        return df.join(keys, on, "left_semi")
    return df.join(keys, on, "left").select(*[df[f"`{c}`"] for c in df.columns], F.coalesce(F.col(hit), F.lit(False)).alias(flag))


def first_of_equal(spark: SparkSession, df: DataFrame, keys: tuple[str, str], again: DataFrame, others: tuple[str, str], name: str) -> DataFrame:
    """df with the column `name`: false for all but one of the rows with equal `keys`, where these are in `others` of again."""
    maybe, number = fresh(df, "_again"), fresh(df, "_number")
    some = maybe_in(df, again, keys, others, maybe)
    held = stored(spark, some.where(F.col(maybe)).withColumn(number, F.monotonically_increasing_id()), "again")
    first = held.groupBy(*keys).agg(F.min(number).alias(number)).select(number, F.lit(True).alias(name))
    out = held.join(first, number, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return some.where(~F.col(maybe)).select(*df.columns, F.lit(True).alias(name)).union(out.select(*df.columns, name))


def sets_of(spark: SparkSession, df: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, items): the full sets, sorted, of the nodes in wanted. nodes: (node, doc_id, key)."""
    ids = stored(spark, nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "key"), "ends")
    some = maybe_in(texts(df), ids, ("doc_id", "key"), ("doc_id", "key")).dropDuplicates(["doc_id", "key"])

    def make():
        return lambda batch: {"node": batch.column(0), "items": [shingle_set(lower_words(t), shingle).tobytes() for t in batch.column(1).to_pylist()]}

    return stored(spark, map_rows(some.join(ids, ["doc_id", "key"]).select("node", "text"), make, "node long, items binary"), "sets")


def confirmed(spark: SparkSession, df: DataFrame, nodes: DataFrame, links: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """The (a, b) of links (a, b, hub) with 100 * intersection >= percent * union on the full sets. A hub's set travels once for each BLOCK of
    its links."""
    links = links.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"))
    sets = sets_of(spark, df, nodes, links.select("node").union(links.select("hub")).distinct(), shingle)
    hubs = links.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = links.join(hubs, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = members.select("hub", "part", "node").join(sets, "node").select("hub", "part", "node", "items")
    hubs = hubs.join(sets.withColumnRenamed("node", "hub"), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "items")
    rows = hubs.union(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("node"))

    def run(batches):
        let_go()
        x = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, node, items in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                y = np.frombuffer(items, np.uint64)
                if node is None:  # the hub comes first
                    x = y
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    a.append(min(hub, node))
                    b.append(max(hub, node))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow_schema("a long, b long"))

    return rows.mapInArrow(run, "a long, b long")


def links_among(ids: np.ndarray, label: np.ndarray, side: np.ndarray, buckets: np.ndarray, items: list[bytes], band: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the labels of the rows of a block, or of two blocks: side 0 and 1 are the blocks', between which pairs count, and 2 a
    single block's. Pairs that share a bucket of an earlier band are left to that."""
    n = np.array([len(x) // 8 for x in items])
    order = np.argsort(n, kind="stable")
    ids, label, side, buckets, n = ids[order], label[order].copy(), side[order], buckets[order], n[order]
    known, item = np.unique(np.frombuffer(b"".join(items[i] for i in order), np.uint64), return_inverse=True)
    item, first = item.astype(np.int32), np.cumsum(n) - n
    last = np.searchsorted(percent * n, 100 * n, "right")  # a larger set may have 100 / percent times the size
    mark, out = np.zeros(len(known), bool), []
    for i in range(len(ids) - 1):
        to = slice(i + 1, int(last[i]))
        may = (label[to] != label[i]) & ((side[to] != side[i]) | (side[i] == 2))
        if not may.any():
            continue
        j = i + 1 + np.flatnonzero(may)
        if band:
            j = j[~(buckets[j, :band] == buckets[i, :band]).any(1)]
        if not len(j):
            continue
        own = item[first[i] : first[i] + n[i]]
        mark[own] = True
        begin = np.cumsum(n[j]) - n[j]
        hit = mark[item[np.repeat(first[j] - begin, n[j]) + np.arange(int(n[j].sum()))]]
        mark[own] = False
        shared = np.add.reduceat(hit, begin, dtype=np.int64)
        for k in j[100 * shared >= percent * (n[i] + n[j] - shared)]:
            if label[k] != label[i]:
                out.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
                label[label == label[k]] = label[i]
    return out


def rest_links(spark: SparkSession, df: DataFrame, met: DataFrame, nodes: DataFrame, label: DataFrame, percent: int, shingle: int) -> DataFrame | None:
    """(a, b), a < b: the links between rows of a bucket that neither its ends nor other links join; None if no bucket has rows to look at.
    A bucket of more than BLOCK rows, or ITEMS shingles, is dealt out by pairs of its blocks."""
    rows = met.where("size > 3 and node != lo and node != hi").select("node", "bucket")
    rows = rows.join(label, "node", "left").select("node", "bucket", F.coalesce("label", "node").alias("label"))
    rows = stored(spark, rows.join(nodes.select("node", "n"), "node"), "crowded")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ITEMS)).cast("int")
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks.alias("blocks"))
    mixed = stored(spark, mixed.where("lo < hi").select("bucket", "blocks"), "mixed")
    if not mixed.limit(1).count():
        return None
    rows = rows.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = stored(spark, rows.drop("n"), "open")
    sets = sets_of(spark, df, nodes, rows.select("node").distinct(), shingle).join(nodes.select("node", "buckets"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "label", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block")
    rows = rows.join(sets, "node").select("node", "label", "bucket", "x", "y", "block", "buckets", "items")
    rows = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def run(batches):
        let_go()
        held, at = [], None

        def give():
            ids, label_, own = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 5))
            _, x, y = at
            buckets = np.array([r[6] for r in held], np.int64)
            side = np.full(len(ids), 2) if x == y else (own == y).astype(int)
            found = links_among(ids, label_, side, buckets, [r[7] for r in held], int(np.flatnonzero(buckets[0] == at[0])[0]), percent)
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow_schema("a long, b long"))

        for batch in slices(batches):
            for r in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if held and r[2:5] != at:
                    yield give()
                    held = []
                at = r[2:5]
                held.append(r)
        if held:
            yield give()

    return rows.mapInArrow(run, "a long, b long")


def joined(spark: SparkSession, df: DataFrame, nodes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(node, label) of the components: first by the stars, then by the pairs of a bucket that these leave open."""
    met = stored(spark, bucket_rows(nodes), "met")
    links = stored(spark, close(star_links(met), nodes, percent), "near")
    sure = stored(spark, confirmed(spark, df, nodes, links, percent, shingle), "sure")
    label = components(spark, sure)
    more = rest_links(spark, df, met, nodes, label, percent, shingle)
    if more is None:
        return label
    more = stored(spark, more, "more")
    return components(spark, sure.union(more)) if more.limit(1).count() else label


def grouped(spark: SparkSession, df: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(doc_id, key, n, component_id, kept) for each row of df, with NO_ID for a missing doc_id. A node of the graph is a class of equal
    sets, by the number of one of its rows; in each component one row is kept, of the least doc_id."""
    sigs = stored(spark, signatures(df, shingle).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = sigs.where("n > 0")
    first = F.min(F.struct((F.col("doc_id") == NO_ID).alias("none"), "doc_id", "key", "row"))
    classes = some.groupBy("set_a", "set_b", "n").agg(first.alias("rep")).select("set_a", "set_b", "n", F.col("rep.row").alias("node"), F.col("rep.doc_id").alias("least"))
    classes = stored(spark, classes, "reps")
    nodes = some.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    nodes = stored(spark, nodes.select("node", "doc_id", "key", "n", "buckets", "sig"), "classes")
    label = joined(spark, df, nodes, percent, shingle)
    linked = label.join(nodes.select("node", "doc_id", "key", F.col("node").alias("row")), "node")
    heads = linked.groupBy("label").agg(first.alias("head")).select("label", F.col("head.doc_id").alias("head_id"), F.col("head.row").alias("head"))
    linked = label.join(heads, "label").select("node", "head_id", "head")
    out = some.select("doc_id", "key", "n", "set_a", "set_b", "row").join(classes, ["set_a", "set_b", "n"]).join(linked, "node", "left")
    kept = (F.col("row") == F.coalesce("head", "node")).alias("kept")
    out = out.select("doc_id", "key", "n", F.coalesce("head_id", "least").alias("component_id"), kept)
    return out.union(sigs.where("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def groups(spark: SparkSession, df: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of df."""
    return grouped(spark, df, percent, shingle).select(unkeyed(), F.col("n").alias("n_shingles"), unkeyed("component_id"), "kept")


def one_of_each(spark: SparkSession, df: DataFrame, percent: int = 80) -> DataFrame:
    """df with one row of each group, of its least doc_id, and all columns. Only documents that may have to go are shuffled."""
    found = grouped(spark, df, percent, SHINGLE).where("n > 0").groupBy(F.col("doc_id").alias("gone"), F.col("key").alias("gone_key"))
    found = stored(spark, found.agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "gone")
    doc, own, maybe = fresh(df, "_doc"), fresh(df, "_own"), fresh(df, "_maybe")
    some = df.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own, text_key())
    gone = found.where("not stays").select(F.col("gone").alias(f"{doc}_gone"), F.col("gone_key").alias(f"{own}_gone"))
    some = maybe_in(some, gone, (doc, own), (f"{doc}_gone", f"{own}_gone"), maybe)
    once = fresh(some, "_once")
    again = found.where("stays and rows > 1").select("gone", "gone_key")
    left = some.where(F.col(maybe)).join(gone, (F.col(doc) == F.col(f"{doc}_gone")) & (F.col(own) == F.col(f"{own}_gone")), "left_anti")
    left = some.where(~F.col(maybe)).select(*df.columns, doc, own).union(left.select(*df.columns, doc, own))
    if again.limit(1).count():
        left = first_of_equal(spark, left, (doc, own), again, ("gone", "gone_key"), once).where(once)
    return left.select(*df.columns)
