"""Batches of files: ingest, state counters, confidences, overrides and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mean4

# File extensions that are taken, and how states are shown.
EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "pdf"]
STATES = {"pending": "En attente", "processing": "En cours", "done": "Terminé", "error": "Erreur", "cancelled": "Annulé"}
MOST_BYTES, MOST_PAGE = 25 << 20, 500
#: What errors are answered with.
HTTP = {"engine": 503, "invalid": 400, "timeout": 504, "missing": 404}


def upload_error(name: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """SRC1: why a file isn't taken, null if it is."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(~extension.isin(EXTENSIONS), "extension").when(size < 1, "empty").when(size > most, "too large")


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC2, SET4: (accepted, rejected) of files (name, size)."""
    judged = files.withColumn("error", upload_error(F.col("name"), F.col("size")))
    return judged.where("error is null").drop("error"), judged.where("error is not null")


def page_confidence(items: DataFrame) -> DataFrame:
    """AGG1: mean confidence of the items (file_id, page, confidence) of each page, to four places."""
    return items.groupBy("file_id", "page").agg(F.coalesce(mean4(F.col("confidence")), F.lit(0.0)).alias("confidence"))


def file_confidence(pages: DataFrame) -> DataFrame:
    """AGG2: the mean of the rounded page means."""
    return pages.groupBy("file_id").agg(mean4(F.col("confidence")).alias("confidence"))


def job_counters(files: DataFrame) -> DataFrame:
    """AGG3, STR3: files (job_id, status) by state; cancelled ones only count in the total (T20)."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = files.groupBy("job_id").agg(F.count("*").alias("total"), n("done").alias("done"), n("error").alias("error"), n("processing").alias("processing"), n("pending").alias("pending"))
    return out.withColumn("progress", (F.col("done") + F.col("error")).cast("double") / F.greatest(F.lit(1), F.col("total")))


def job_average(files: DataFrame) -> DataFrame:
    """AGG2 over a job: the mean confidence of its finished files."""
    done = F.when(F.col("status") == "done", F.col("confidence"))
    return files.groupBy("job_id").agg(F.coalesce(mean4(done), F.lit(0.0)).alias("average"))


def assembled(items: DataFrame, timing: DataFrame) -> DataFrame:
    """PRJ4: pages from their items (file_id, page, item_idx, text, confidence) and what reading took (file_id, page, elapsed_ms): the text, line by
    line, the mean confidence and the time to two places. A page without items has an empty text and confidence 0."""
    pages = items.groupBy("file_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("item_idx", "text")))), lambda s: s["text"]), "\n").alias("text"),
        mean4(F.col("confidence")).alias("confidence"),
    )
    out = timing.join(pages, ["file_id", "page"], "left")
    return out.select("file_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.round("elapsed_ms", 2).alias("elapsed_ms"))


def job_summary(files: DataFrame) -> DataFrame:
    """PRJ3: a job's counters, progress and average in one row; files (job_id, status, confidence)."""
    return job_counters(files).join(job_average(files), "job_id")


def response_totals(items: DataFrame) -> DataFrame:
    """AGG6: (total, ok, errors) of the items (request_id, status) of each request; what isn't ok is an error."""
    ok = F.count_if(F.col("status") == "ok")
    return items.groupBy("request_id").agg(F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("errors"))


def http_status(kind: Column) -> Column:
    """APP1b: the status that an error of a kind is answered with; 500 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in HTTP.items() for x in p]), kind), F.lit(500))


def joined_text(rows: DataFrame, by: list[str], order: str, column: str, separator: str) -> DataFrame:
    """AGG4: texts of a page or document in order; empty ones are left out."""
    some = F.collect_list(F.when(F.col(column) != "", F.struct(order, column)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(some), lambda s: s[column]), separator).alias("text"))


def overlaid(found: DataFrame, overrides: DataFrame) -> DataFrame:
    """OVL1: the detail view. Fields (page_id, key, value, status) that have an override take its value, are valid and marked as edited."""
    o = overrides.select("page_id", "key", F.col("value").alias("new"))
    out = found.join(o, ["page_id", "key"], "left")
    edited = F.col("new").isNotNull()
    return out.select("page_id", "key", F.coalesce("new", "value").alias("value"), F.when(edited, "valid").otherwise(F.col("status")).alias("status"), edited.alias("edited"))


def overlaid_for_export(found: DataFrame, overrides: DataFrame) -> DataFrame:
    """OVL2: the export. Overrides of fields that weren't read are added, with confidence 1."""
    o = overrides.select("page_id", "key", F.col("value").alias("new"))
    out = found.select("page_id", "key", "value", "confidence").join(o, ["page_id", "key"], "full")
    return out.select("page_id", "key", F.coalesce("new", "value").alias("value"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def overrides_edited(overrides: DataFrame, edits: DataFrame) -> DataFrame:
    """OVL3, STR5: edits (page_id, key, value, seq) applied in order of seq; an empty value takes the override away."""
    rows = overrides.select("page_id", "key", "value", F.lit(-1).cast("long").alias("seq")).union(edits.select("page_id", "key", "value", F.col("seq").cast("long")))
    return rows.groupBy("page_id", "key").agg(F.max_by("value", "seq").alias("value")).where("value <> ''")


def override_map(current: Column, edits: Column) -> Column:
    """MAP1: the same on map columns."""
    kept = F.map_filter(current, lambda k, v: ~F.map_contains_key(edits, k))
    return F.map_filter(F.map_concat(kept, edits), lambda k, v: v != "")


def state_label(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in STATES.items() for x in p]), status)


def searched(files: DataFrame, needle: str) -> DataFrame:
    """FLT4: files whose name or shown state contains the needle, in any case."""
    low = F.lit(needle.strip().lower())
    return files.where(F.contains(F.lower("name"), low) | F.contains(F.lower(state_label(F.col("status"))), low))


def page_of(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """SRT1, SRT2: one page of rows; size is clamped to MOST_PAGE."""
    size = max(1, min(size, MOST_PAGE))
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def latest_state(events: DataFrame) -> DataFrame:
    """STR2: state of each file after events (file_id, seq, state); a cancel only moves files that are pending."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "state")))
    step = lambda s, e: F.when((e["state"] == "cancelled") & (s != "pending"), s).when(s.isin("done", "error", "cancelled"), s).otherwise(e["state"])
    return events.groupBy("file_id").agg(F.aggregate(ordered, F.lit("pending"), step).alias("state"))
