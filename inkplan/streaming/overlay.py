"""STR1 with OVL1 and OVL2: results of a job joined with edits as both come in.

joined() is a full outer join of two streams with watermarks on both sides: a field that was read meets its edits of the time from its reading on, as
far as `within`; what has met nothing when the watermarks have passed goes out alone. So the state holds the fields and edits of that time only. Each edit
of a field makes a row, in any order; detail() and export() take the last of them, so they give, of the rows written so far, what
batches.overlaid() and overlaid_for_export() give of the tables.

Defined cases: rows with a null page, key or time are left out on both sides; an edit to an empty value takes the edits before it away; of edits with
one number the greater value is the last.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WITHIN = timedelta(hours=1)


def _span(d: timedelta) -> str:
    return f"{round(d.total_seconds() * 1000)} milliseconds"


def joined(found: DataFrame, edits: DataFrame, late: timedelta = timedelta(minutes=10), within: timedelta = WITHIN) -> DataFrame:
    """(page_id, key, value, status, confidence, edit, seq) of the fields (page_id, key, value, status, confidence, ts) and the edits (page_id, key, value,
    seq, ts), both streams or both tables."""
    complete = "page_id is not null and key is not null and ts is not null"
    f = found.where(complete).select("page_id", "key", "value", "status", "confidence", F.col("ts").alias("read_at")).withWatermark("read_at", _span(late))
    e = edits.where(complete).select(F.col("page_id").alias("edit_page"), F.col("key").alias("edit_key"), F.col("value").alias("edit"), "seq", F.col("ts").alias("edited_at")).withWatermark("edited_at", _span(late))
    near = F.expr(f"page_id = edit_page and key = edit_key and edited_at >= read_at and edited_at <= read_at + interval {_span(within)}")
    out = f.join(e, near, "full_outer")
    return out.select(F.coalesce("page_id", "edit_page").alias("page_id"), F.coalesce("key", "edit_key").alias("key"), "value", "status", "confidence", "edit", "seq", F.col("read_at").isNotNull().alias("was_read"))


def _last(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("edit"), F.struct("seq", "edit"))["edit"]  # rows without an edit have the least seq, null
    one = rows.groupBy("page_id", "key").agg(F.bool_or("was_read").alias("was_read"), F.max(F.when(F.col("was_read"), F.struct("value", "status", "confidence"))).alias("f"), last.alias("edit"))
    return one.withColumn("edit", F.when(F.col("edit") != "", F.col("edit")))


def detail(rows: DataFrame) -> DataFrame:
    """OVL1 of the rows that joined() has written."""
    edited = F.col("edit").isNotNull()
    return _last(rows).where("was_read").select(
        "page_id", "key", F.coalesce("edit", "f.value").alias("value"), F.when(edited, "valid").otherwise(F.col("f.status")).alias("status"), edited.alias("edited")
    )


def export(rows: DataFrame) -> DataFrame:
    """OVL2 of the rows that joined() has written."""
    kept = _last(rows).where("was_read or edit is not null")
    return kept.select("page_id", "key", F.coalesce("edit", "f.value").alias("value"), F.coalesce("f.confidence", F.lit(1.0)).alias("confidence"))
