"""Pairing labels with values on a page.

Every join is within a page: page_id is an equality key, so plans are hash or sort-merge joins with range conditions, never nested
loops. Rows of one page are at most what one page shows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.decode import digit_windows_column
from . import fields

LEAST_CONFIDENCE = 0.50
SAME_LINE_GAP, BELOW_GAP, NAME_BELOW_GAP = 400.0, 300.0, 80.0


def normalised(items: DataFrame) -> DataFrame:
    """PRJ1, FLT1, FLT2: items (page_id, item_idx, text, confidence, box) with raw, clean and keyword forms, rectangle and label key; blank
    items and items that have a box but little confidence are dropped."""
    kept = items.where((F.trim("text") != "") & ~((F.coalesce(F.size("box"), F.lit(0)) > 0) & (F.col("confidence") < LEAST_CONFIDENCE)))
    raw = F.trim("text")
    out = kept.withColumn("raw", raw).withColumn("clean", text.clean(raw)).withColumn("norm", text.keyword(raw))
    return out.withColumn("rect", geometry.rect(F.col("box"))).withColumn("label_key", fields.label_key(F.col("norm")))


def is_value(c: Column = None) -> Column:
    """Items that may be a value: no label, no noise, no row that ends with a colon."""
    return F.col("label_key").isNull() & ~text.is_noise(F.col("clean")) & ~text.ends_with_colon(F.col("raw"))


def inline(entries: DataFrame) -> DataFrame:
    """TXT7: (page_id, item_idx, key, value, confidence) of items of the form "label : value"."""
    found = entries.where(text.has_colon(F.col("raw"))).withColumn("key", fields.label_key(text.keyword(text.label_part(F.col("raw")))))
    found = found.withColumn("value", text.value_part(F.col("raw")))
    return found.where(F.col("key").isNotNull() & (F.col("value") != "")).select("page_id", "item_idx", "key", "value", "confidence", "box")


def candidates(labels: DataFrame, values: DataFrame, below: bool = False) -> DataFrame:
    """JN3 (right of the label on its line) or JN4 (below it): (label, value) pairs of a page with their gap."""
    l = labels.select("page_id", F.col("item_idx").alias("label_idx"), F.col("label_key").alias("key"), F.col("rect").alias("l"))  # noqa: E741
    v = values.select("page_id", F.col("item_idx").alias("value_idx"), "raw", "clean", "confidence", F.col("rect").alias("v"))
    near, gap = _near({"rect": F.col("l"), "key": F.col("key")}, {"rect": F.col("v")}, below)
    return l.join(v, "page_id").where(near).withColumn("gap", gap)


def paired(entries: DataFrame) -> DataFrame:
    """JN3 + JN4 + JN5 without consumption: exact on pages where no value is the first choice of two labels. A page's labels and values meet in
    arrays: the items are normalised once and shuffled once, by page."""
    item = F.struct("item_idx", "raw", "clean", "confidence", "rect", F.col("label_key").alias("key"))
    pages = entries.groupBy("page_id").agg(
        F.collect_list(F.when(F.col("label_key").isNotNull(), item)).alias("labels"), F.collect_list(F.when(is_value(), item)).alias("values")
    )
    rows = pages.select("page_id", "values", F.explode("labels").alias("label"))
    form = F.create_map(*[F.lit(x) for k, p in fields.PATTERN.items() if p for x in (k, p)])
    rows = rows.withColumn("form", F.try_element_at(form, F.col("label.key")))

    def choice(below: bool) -> Column:
        def ranked(v: Column) -> Column:
            near, gap = _near(F.col("label"), v, below)
            odd = F.when(F.col("form").isNotNull() & F.rlike(v["clean"], F.col("form")), 0).otherwise(1)
            return F.when(near, F.struct(odd.alias("odd"), gap.cast("double").alias("gap"), v["clean"].alias("clean"), v["item_idx"].alias("value_idx"), v["raw"].alias("raw"), v["confidence"].alias("confidence")))

        return F.array_min(F.array_compact(F.transform("values", ranked)))

    best = F.coalesce(choice(False), choice(True))
    out = rows.select("page_id", F.col("label.item_idx").alias("label_idx"), F.col("label.key").alias("key"), best.alias("v"))
    return out.where("v is not null").select("page_id", "label_idx", "key", "v.value_idx", "v.raw", "v.clean", "v.confidence", "v.gap")


def _near(label: Column, value: Column, below: bool) -> tuple[Column, Column]:
    """Whether a value stands right of a label on its line, or below it, and how far."""
    l, v = label["rect"], value["rect"]  # noqa: E741
    height = F.greatest(F.lit(1.0), l["y1"] - l["y0"])
    if below:
        gap = v["y0"] - l["y1"]
        most = F.when(label["key"].isin("nom", "prenom"), NAME_BELOW_GAP).otherwise(BELOW_GAP)
        return (gap > 0) & (gap <= most) & (v["x1"] >= l["x0"] - 2 * height) & (v["x0"] <= l["x1"] + 2 * height), gap
    gap = v["x0"] - l["x1"]
    apart = F.abs((v["y0"] + v["y1"]) / 2 - (l["y0"] + l["y1"]) / 2)
    return (gap >= -2) & (gap <= SAME_LINE_GAP) & (apart <= F.greatest(height, F.lit(8.0)) * 0.5), gap


def contested_pages(pairs: DataFrame) -> DataFrame:
    """Pages where a value is the first choice of two labels; there the order of the labels decides (greedy())."""
    return pairs.groupBy("page_id", "value_idx").agg(F.count("*").alias("n")).where("n > 1").select("page_id").distinct()


def page_numbers(batch) -> np.ndarray:
    """The number of each row's page in a batch that is sorted by page, from 0; rows without page_id are one page."""
    page = batch.column("page_id")
    there, ids = page.is_valid().to_numpy(zero_copy_only=False), page.fill_null(0).to_numpy()
    return np.cumsum(np.r_[False, (ids[1:] != ids[:-1]) | (there[1:] != there[:-1])])


def greedy(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """JN6 for whole pages: labels in reading order, each taking a value that no earlier one took. The first labels of all pages choose together, then
    the second ones, and so on; a label meets its page's values only. batch: flat() rows by page and item. Returns the row of the label, the row of
    its value and whether both are in one item, by page; items with both come first."""
    page, clean = page_numbers(batch), batch.column("clean")
    x0, y0, x1, y1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
    keys = batch.column("key").dictionary_encode()
    names, code = keys.dictionary.to_pylist(), keys.indices.fill_null(-1).to_numpy()
    both = batch.column("inline_key").is_valid().to_numpy(zero_copy_only=False)
    free = (code < 0) & ~both & ~batch.column("noise").fill_null(False).to_numpy(zero_copy_only=False)
    labels, values = np.flatnonzero((code >= 0) & ~both), np.flatnonzero(free)
    most = np.array([NAME_BELOW_GAP if n in ("nom", "prenom") else BELOW_GAP for n in names])
    turn = np.arange(len(labels)) - np.searchsorted(page[labels], page[labels])
    order = np.argsort(turn, kind="stable")
    rounds = np.split(labels[order], np.flatnonzero(np.diff(turn[order])) + 1) if len(labels) else []
    took = [(np.flatnonzero(both),) * 2]
    for own in rounds:
        begin, end = (np.searchsorted(page[values], page[own], side) for side in ("left", "right"))
        n = end - begin
        who = np.repeat(np.arange(len(own)), n)
        v = values[np.arange(len(who)) + np.repeat(begin - (np.cumsum(n) - n), n)]
        who, v = who[free[v]], v[free[v]]
        l = own[who]  # noqa: E741
        height, right, under = np.maximum(1.0, y1[l] - y0[l]), x0[v] - x1[l], y0[v] - y1[l]
        line = (np.abs((y0[v] + y1[v]) / 2 - (y0[l] + y1[l]) / 2) <= np.maximum(height, 8.0) / 2) & (right >= -2) & (right <= SAME_LINE_GAP)
        below = (under > 0) & (under <= most[code[l]]) & (x1[v] >= x0[l] - 2 * height) & (x0[v] <= x1[l] + 2 * height)
        near = line | (below & (np.bincount(who[line], minlength=len(own)) == 0)[who])
        who, v, gap = who[near], v[near], np.where(line, right, under)[near]
        odd, choice = np.ones(len(v), bool), np.bincount(who, minlength=len(own))[who] > 1
        for k in np.unique(code[own[who[choice]]]):
            if form := fields.PATTERN[names[k]]:
                at = np.flatnonzero(choice & (code[own[who]] == k))
                odd[at] = [not re.match(form, c) for c in clean.take(v[at]).to_pylist()]
        best = np.lexsort((gap, odd, who))
        if any_equal(who[best], odd[best], gap[best]):
            texts = clean.take(v).to_pylist()
            place = {t: k for k, t in enumerate(sorted(set(texts)))}
            best = np.lexsort(([place[t] for t in texts], gap, odd, who))
        best = best[np.r_[True, np.diff(who[best]) > 0][: len(best)]]
        free[v[best]] = False
        took.append((own[who[best]], v[best]))
    label, value = (np.concatenate(x) for x in zip(*took))
    order = np.lexsort((label, ~both[label], page[label]))
    return label[order], value[order], both[label[order]]


def any_equal(*columns: np.ndarray) -> bool:
    """Whether two rows that follow one another agree in all columns."""
    return bool(np.logical_and.reduce([c[1:] == c[:-1] for c in columns]).any())


def flat(entries: DataFrame) -> DataFrame:
    """Entries with all that greedy() needs, for a grouped function; with their box if they have it."""
    value = F.when(text.has_colon(F.col("raw")), text.value_part(F.col("raw")))
    inl = F.when(text.has_colon(F.col("raw")) & (value != ""), fields.label_key(text.keyword(text.label_part(F.col("raw")))))
    noise = text.is_noise(F.col("clean")) | text.ends_with_colon(F.col("raw"))
    box = [c for c in entries.columns if c == "box"]
    return entries.select(F.col("page_id").cast("long").alias("page_id"), "item_idx", "raw", "clean", "confidence", *box, F.col("label_key").alias("key"), noise.alias("noise"), inl.alias("inline_key"), value.alias("inline_value"), "rect.*")


def per_page(rows: DataFrame, found, schema: str) -> DataFrame:
    """found(batch) for Arrow batches of flat() rows that hold whole pages: pages are sorted together by one shuffle, and one that goes on from a batch to the
    next waits for its end. found gives a dict of columns."""

    def run(batches):
        import pyarrow as pa

        box = pa.list_(pa.list_(pa.int32()))
        kinds = {"page_id": pa.int64(), "occurrence": pa.int32(), "key": pa.string(), "value": pa.string(), "confidence": pa.float64(), "original": pa.string(), "box": box}
        kinds |= dict.fromkeys(("_series", "_identifier", "_session", "_exam"), pa.string()) | {"_earlier": pa.list_(pa.string())}

        def give(pages):
            columns = found(pa.concat_batches(pages))
            arrays = [x.cast(kinds[n]) if isinstance(x, pa.Array) else pa.array(x, kinds[n]) for n, x in columns.items()]
            return pa.RecordBatch.from_arrays(arrays, names=list(columns))

        waiting: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            page = page_numbers(batch)
            last = int(np.searchsorted(page, page[-1]))  # where its last page begins
            if last:
                yield give([*waiting, batch.slice(0, last)])
                waiting = []
            elif waiting and waiting[-1].column("page_id")[0].as_py() != batch.column("page_id")[0].as_py():
                yield give(waiting)
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield give(waiting)

    return rows.repartition("page_id").sortWithinPartitions("page_id", "item_idx").drop("item_idx").mapInArrow(run, schema)


def greedy_pages(entries: DataFrame) -> DataFrame:
    """JN6 over whole pages: (page_id, occurrence, key, value, confidence), and box if entries have it."""

    def found(batch) -> dict:
        import pyarrow as pa
        import pyarrow.compute as pc

        label, value, both = greedy(batch)
        page = page_numbers(batch)[label]
        of = lambda name, at: batch.column(name).take(at)
        out = {"page_id": of("page_id", label), "occurrence": np.arange(len(page)) - np.searchsorted(page, page)}
        out["key"] = pc.if_else(pa.array(both), of("inline_key", label), of("key", label))
        out["value"] = pc.if_else(pa.array(both), of("inline_value", value), of("raw", value))
        return out | {c: of(c, value) for c in ("confidence", "box") if c in batch.schema.names}

    box = ", box array<array<int>>" if "box" in entries.columns else ""
    return per_page(flat(entries), found, f"page_id long, occurrence int, key string, value string, confidence double{box}")


def numeric_harvest(entries: DataFrame, value: Column, key: str, length: int, slack: int = 1) -> DataFrame:
    """JN7 for one field: the digit window of the page with the least score: 1000 for a window off its run's border, the distance to the
    label / 2000, and for national numbers 400 if the first digit isn't 0 or 1. value: which entries are looked through. One grouping by page."""
    spaced = F.regexp_replace(text.deconfuse(F.col("clean")), r"[^0-9\s]", " ")
    item = F.struct("item_idx", "confidence", "rect", digit_windows_column(spaced, length, slack).alias("windows"))
    label = F.min_by("rect", F.when(F.col("label_key") == key, F.col("item_idx"))).alias("label")
    pages = entries.groupBy("page_id").agg(label, F.collect_list(F.when(value, item)).alias("values")).where("label is not null")

    def ranked(v: Column) -> Column:
        far = geometry.distance(F.col("label"), v["rect"]) / 2000.0

        def of(w: Column) -> Column:
            score = w["penalty"] * 1000.0 + far
            if key == "cin":
                score = score + F.when(w["window"].rlike("^[01]"), 0.0).otherwise(400.0)
            return F.struct(score.alias("score"), v["item_idx"].alias("item_idx"), w["window"].alias("value"), v["confidence"].alias("confidence"))

        return F.transform(v["windows"], of)

    best = F.array_min(F.flatten(F.transform("values", ranked)))
    return pages.select("page_id", best.alias("b")).where("b is not null").select("page_id", F.lit(key).alias("key"), "b.item_idx", "b.value", "b.confidence", "b.score")


def printed_block(values: DataFrame) -> DataFrame:
    """JN9: (page_id, serie, identifiant) printed as three and six digits of which the latter begin with the former; the most certain of a page,
    if at all certain."""
    form = r"(?:^|[^0-9])([0-9]{3})[\s./|-]*([0-9]{6})(?:[^0-9]|$)"
    s, i = F.regexp_extract("clean", form, 1), F.regexp_extract("clean", form, 2)
    found = values.withColumn("serie", s).withColumn("identifiant", i).where((F.col("serie") != "") & F.col("identifiant").startswith(F.col("serie")))
    best = F.max(F.struct("confidence", (-F.col("item_idx")).alias("o"), "serie", "identifiant"))
    return found.groupBy("page_id").agg(best.alias("b")).where("b.confidence >= 0.5").select("page_id", "b.serie", "b.identifiant", "b.confidence")


def printed_repair(found: DataFrame, values: DataFrame) -> DataFrame:
    """Fields with series and identifier replaced by a printed block, where the page has both fields; a changed field is at least 0.92 sure."""
    block = printed_block(values).select("page_id", "serie", "identifiant")
    both = found.where(F.col("key").isin("serie", "identifiant")).groupBy("page_id").agg(F.count_distinct("key").alias("n")).where("n = 2").drop("n")
    new = F.when(F.col("key") == "serie", F.col("serie")).when(F.col("key") == "identifiant", F.col("identifiant"))
    out = found.join(block.join(both, "page_id", "left_semi"), "page_id", "left").withColumn("new", new)
    changed = F.col("new").isNotNull() & (F.col("new") != text.digits(F.col("value")))
    return out.select(
        *[c for c in found.columns if c not in ("value", "confidence")], F.when(changed, F.col("new")).otherwise(F.col("value")).alias("value"),
        F.when(changed, F.greatest("confidence", F.lit(0.92))).otherwise(F.col("confidence")).alias("confidence"),
    )
