"""Row bands of a page: merging, stacking, chunking, and joins by nearness. Every window is within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mean4


def merged(bands: DataFrame, gap: int = 24) -> DataFrame:
    """GEO5: bands (page_id, y0, y1) whose distance is at most `gap`, as one, with their number: gaps and islands over a running maximum. Equal bands
    become one row with their number first, so that the windows' order has no ties and a page with many bands is no larger than its
    different ones. Bands with a missing end come last."""
    different = bands.groupBy("page_id", "y0", "y1").agg(F.count("*").alias("n"))
    order = Window.partitionBy("page_id").orderBy(F.asc_nulls_last("y0"), F.asc_nulls_last("y1"))
    before = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = different.withColumn("new", F.when(before.isNull() | (F.col("y0") - before > gap), 1).otherwise(0))
    grouped = marked.withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("page_id", "band").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n"))


def stacked(rows: DataFrame, gap: int = 48) -> DataFrame:
    """GEO6: where each row (page_id, row_no, height) stands when a page's rows are stacked with a gap."""
    order = Window.partitionBy("page_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.coalesce(F.sum(F.col("height") + gap).over(order), F.lit(0)).cast("long"))


def chunked(rows: DataFrame, size: int = 16) -> DataFrame:
    """GEO7: absolute row numbers from 1, and the chunk of at most `size` rows that each is in."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("row_no"))
    return rows.withColumn("number", n).withColumn("chunk", F.floor((F.col("number") - 1) / size).cast("int"))


def nearest(boxes: DataFrame, bands: DataFrame) -> DataFrame:
    """JN14: the band (page_id, band, y) of each box (page_id, box, y) with the least distance, the first of equals. Bands and boxes of a page are sorted by y
    once; rows of one y share the first band that stands there, and a box looks at the last y with a band up to its own and at the next one after it, so no
    box meets more than two bands. Boxes without y, and of pages without bands, have no nearest band."""
    whole = lambda df, name, other: df.where(f"page_id is not null and y is not null and {name} is not null").select("page_id", F.col("y").cast("double").alias("y"), name, other)
    none = lambda column, df: F.lit(None).cast(df.schema[column].dataType).alias(column)
    rows = whole(boxes, "box", none("band", bands)).unionByName(whole(bands, "band", none("box", boxes)))
    order = Window.partitionBy("page_id").orderBy("y")
    here = rows.withColumn("band", F.min("band").over(order.rangeBetween(Window.currentRow, Window.currentRow)))
    here = here.withColumn("at", F.when(F.col("band").isNotNull(), F.struct("y", "band")))
    above = F.last("at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = here.withColumns({"above": above, "below": F.expr("lead(at) ignore nulls over (partition by page_id order by y)")}).where("box is not null")
    side = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.abs(F.col("y") - F.col(f"{name}.y")).alias("d"), F.col(f"{name}.band").alias("band")))
    best = F.least(side("above"), side("below"))
    return met.select("page_id", "box", best.alias("b")).where("b is not null").select("page_id", "box", "b.band", F.col("b.d").alias("distance"))


def with_metadata(readings: DataFrame, bands: DataFrame) -> DataFrame:
    """JN15: readings (page_id, number) with their row's metadata, if it has any."""
    return readings.join(bands, ["page_id", "number"], "left")


def same_row(items: DataFrame, rows: DataFrame, within: int = 8) -> DataFrame:
    """JN16: the first row (page_id, row_no, top) whose top is less than `within` from the item's (page_id, item, top). Tops of a page become one row each
    first, so that a window over whole pixels holds 2 * within - 1 of them at most, however many items and rows a page has."""
    tops = rows.where("top is not null").groupBy("page_id", F.col("top").cast("double").alias("top")).agg(F.min("row_no").alias("row_no"))
    asked = items.select("page_id", F.col("top").cast("double").alias("top"), F.lit(None).cast(rows.schema["row_no"].dataType).alias("row_no")).where("top is not null")
    each = tops.unionByName(asked).groupBy("page_id", "top").agg(F.min("row_no").alias("row_no"))
    reach = within - 1e-6  # tops are pixels; a range takes its ends in
    near = each.select("page_id", "top", F.expr(f"min(row_no) over (partition by page_id order by top range between {reach!r}D preceding and {reach!r}D following) as row_no")).where("row_no is not null")
    out = items.select("page_id", "item", F.col("top").cast("double").alias("top")).distinct().join(near, ["page_id", "top"])
    return out.groupBy("page_id", "item").agg(F.min("row_no").alias("row_no"))


def improvements(rows: DataFrame) -> DataFrame:
    """JN18: of rows (page_id, key, ord, confidence) those that beat all before them."""
    before = F.max("confidence").over(Window.partitionBy("page_id", "key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("confidence") > F.col("before"))).drop("before")


def outside_grids(bands: DataFrame, grids: DataFrame, margin: int = 48) -> DataFrame:
    """FLT10: bands (page_id, y0, y1) that no grid of the page comes near to."""
    near = bands.alias("b").join(grids.alias("g"), (F.col("b.page_id") == F.col("g.page_id")) & (F.col("b.y1") >= F.col("g.y0") - margin) & (F.col("b.y0") <= F.col("g.y1") + margin), "left_anti")
    return near.select("b.*")


def grid_reading(cells: DataFrame) -> DataFrame:
    """AGG14: digits of a grid (page_id, grid, pos, digit, confidence, x0, y0, x1, y1) in order, mean confidence and the box around them."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "digit")))
    return cells.groupBy("page_id", "grid").agg(
        F.array_join(F.transform(ordered, lambda s: s["digit"]), "").alias("text"), mean4(F.col("confidence")).alias("confidence"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def likelihood(tokens: DataFrame) -> DataFrame:
    """AGG13: the geometric mean of the token probabilities (line_id, p), clamped."""
    mean = F.exp(F.avg(F.ln("p")))
    return tokens.groupBy("line_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("confidence"))


#: Rows whose value isn't read from the row itself.
NOT_READ_AGAIN = ["cin", "serie", "identifiant", "zone_signature", "anonyme"]


def readable_again(rows: DataFrame) -> DataFrame:
    """FLT11: rows (key) that a second reading may improve."""
    return rows.where(~F.col("key").isin(NOT_READ_AGAIN))


def incomplete(text: Column) -> Column:
    """REC6: a row without a value after its last colon, or without any text; it is read again."""
    t = F.trim(F.coalesce(text, F.lit("")))
    tail = F.element_at(F.split(t, "[:：]"), -1)
    return (t == "") | (t.rlike("[:：]") & ~tail.rlike(r"[\p{L}\p{N}]"))


def reading_order(column: Column) -> Column:
    """GEO10: an array of structs with y0 and x0 first, sorted."""
    return F.array_sort(column)
