"""Pages (name, page, width, height, pixels) as tables: what is on them is found by windows, groupings and joins over runs of ink.

A page becomes rows of dark runs, one for each stretch of dark pixels in a line of pixels, by a small Arrow function that holds one page; bands, lines,
ratios and thresholds are then Spark's. Steps that need a page's pixels at once (grids of drawn cells, barcodes, preparation) go page by page too, with
their results, or an error, as rows.

Defined cases: a page without pixels, or whose pixels don't fit its size, has no runs, and an error row in the page-by-page steps; a white page has no
runs, so inked() lists it with ratio 0; pages are told apart by (name, page).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import barcodes, prepare, raster

PAGE = ["name", "page"]
_INPUT = ["name", "page", "width", "height", "pixels"]


def by_image(pages: DataFrame, rows_of: Callable[[np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """(name, page, the columns of schema) for what rows_of(image) yields, page by page. With a column `error` in the schema, a page that fails is a row
    with it; else it has no rows."""
    ddl = f"name string, page int, {schema}"
    target = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, page, width, height, pixels = (b.column(i)[k].as_py() for i in range(5))
                try:
                    image = np.frombuffer(pixels, np.uint8).reshape(height, width, -1)
                    rows = [{"name": name, "page": page, **r} for r in rows_of(image)]
                except Exception as e:
                    if "error" not in target.names:
                        continue
                    rows = [{"name": name, "page": page, "error": f"{type(e).__name__}: {e}"[:300]}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    return pages.select(*_INPUT).mapInArrow(run, ddl)


def _runs(image: np.ndarray) -> Iterator[dict]:
    dark = (raster.grey(image) < raster.DARK).astype(np.int8)
    edge = np.diff(np.pad(dark, ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1]
    for a, b, c in zip(y.tolist(), x0.tolist(), x1.tolist()):
        yield {"width": image.shape[1], "height": image.shape[0], "y": a, "x0": b, "x1": c}


def runs(pages: DataFrame) -> DataFrame:
    """(name, page, width, height, y, x0, x1): the dark runs [x0, x1) of each line of pixels."""
    return by_image(pages, _runs, "width int, height int, y int, x0 int, x1 int")


def lines_of_pixels(found: DataFrame) -> DataFrame:
    """(name, page, width, height, y, ink, x0, x1) of the lines with ink, from runs()."""
    return found.groupBy(*PAGE, "y").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.sum(F.col("x1") - F.col("x0")).alias("ink"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def inked(pages: DataFrame, least: float = raster.LEAST_INK) -> DataFrame:
    """FLT7: (name, page, ratio, kept): the share of dark pixels of each page, and whether it is enough to be read."""
    some = runs(pages).groupBy(*PAGE).agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"))
    all_ = pages.select(*PAGE, "width", "height").distinct().join(some, PAGE, "left")
    ratio = F.coalesce(F.col("ink") / (F.col("width").cast("long") * F.col("height")), F.lit(0.0))
    return all_.select(*PAGE, ratio.alias("ratio"), (ratio >= least).alias("kept"))


def _islands(rows: DataFrame, gap: int) -> DataFrame:
    """rows (name, page, y) with `island`: one number for rows of a page that are at most `gap` empty lines apart."""
    order = Window.partitionBy(*PAGE).orderBy("y")
    new = F.when(F.col("y") - F.lag("y").over(order) <= gap + 1, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order)).drop("_new")


def ink_bands(found: DataFrame, least: float = 0.10, gap: int = 3, extent: float = 0.30) -> DataFrame:
    """IMG11: (name, page, band, y0, y1, x0, x1) of bands of lines with at least `least` ink over at least `extent` of the width, from runs(). Lines with
    less ink that lie within a band count for its extent: they are the ones between two lines of one band."""
    lines = lines_of_pixels(found)
    strong = _islands(lines.where(F.col("ink") / F.col("width") >= least), gap).select(*PAGE, "y", "island")
    merged = lines.join(strong, [*PAGE, "y"], "left")
    order = Window.partitionBy(*PAGE).orderBy("y")
    before = F.last("island", True).over(order)
    after = F.first("island", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    inside = merged.withColumn("_b", before).withColumn("_a", after).where("_b = _a")
    ends = [F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("width").alias("width")]
    wide = inside.groupBy(*PAGE, F.col("_b").alias("island")).agg(*ends).where((F.col("x1") - F.col("x0")) >= extent * F.col("width"))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0"))
    return wide.select(*PAGE, number.alias("band"), "y0", "y1", "x0", "x1")


def text_lines(found: DataFrame, least: int = 8, most: int | None = None) -> DataFrame:
    """IMG13, SRT7: (name, page, line, y0, y1): stretches of lines with ink, at least `least` high; with `most`, a page's first so many."""
    rows = _islands(found.select(*PAGE, "y").distinct(), 0).groupBy(*PAGE, "island").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    out = rows.where(F.col("y1") - F.col("y0") >= least).withColumn("line", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0")))
    return (out if most is None else out.where(F.col("line") <= most)).select(*PAGE, "line", "y0", "y1")


def _grids(image: np.ndarray) -> Iterator[dict]:
    for k, g in enumerate(raster.digit_grids(image)):
        for i, (x0, y0, x1, y1) in enumerate(g["cells"]):
            yield {"grid": k, "key": g["key"], "pos": i, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def digit_grids(pages: DataFrame) -> DataFrame:
    """IMG10: (name, page, grid, key, pos, x0, y0, x1, y1) of the drawn cells."""
    return by_image(pages, _grids, "grid int, key string, pos int, x0 int, y0 int, x1 int, y1 int")


def form_structure(pages: DataFrame, bands: int = 3) -> DataFrame:
    """FLT9: (name, page, is_form): a page with a digit grid or at least three bands."""
    grids = digit_grids(pages).select(*PAGE).distinct().withColumn("_grid", F.lit(True))
    many = ink_bands(runs(pages)).groupBy(*PAGE).agg((F.count("*") >= bands).alias("_bands"))
    out = pages.select(*PAGE).distinct().join(grids, PAGE, "left").join(many, PAGE, "left")
    return out.select(*PAGE, (F.coalesce("_grid", F.lit(False)) | F.coalesce("_bands", F.lit(False))).alias("is_form"))


def _histogram(image: np.ndarray) -> Iterator[dict]:
    n = np.bincount(raster.grey(image).ravel(), minlength=256)
    for v in np.flatnonzero(n).tolist():
        yield {"value": v, "n": int(n[v])}


def otsu(pages: DataFrame) -> DataFrame:
    """IMG6: (name, page, threshold) of greatest variance between the two classes, by running sums over the grey values of a page; 127 for a page of one
    value."""
    n = by_image(pages, _histogram, "value int, n long").groupBy(*PAGE, "value").agg(F.sum("n").alias("n"))
    run, whole = Window.partitionBy(*PAGE).orderBy("value"), Window.partitionBy(*PAGE)
    below, mass = F.sum("n").over(run).cast("double"), F.sum(F.col("n") * F.col("value")).over(run).cast("double")
    total, all_mass = F.sum("n").over(whole).cast("double"), F.sum(F.col("n") * F.col("value")).over(whole).cast("double")
    sums = n.select(*PAGE, "value", below.alias("b"), mass.alias("m"), total.alias("t"), all_mass.alias("a"))
    between = F.when(F.col("b") < F.col("t"), F.pow(F.col("a") * F.col("b") / F.col("t") - F.col("m"), 2) / (F.col("b") * (F.col("t") - F.col("b"))))
    best = F.max(F.when(between.isNotNull(), F.struct(between.alias("v"), (-F.col("value")).alias("less"))))
    return sums.groupBy(*PAGE).agg(best.alias("x")).select(*PAGE, F.coalesce(-F.col("x.less"), F.lit(127)).alias("threshold"))


def prepared(pages: DataFrame, **steps) -> DataFrame:
    """IMG1 to IMG8: (name, page, width, height, pixels, what, error): each page prepared by the steps of prepare.prepared(), with what was done as a map."""

    def rows_of(image: np.ndarray) -> Iterator[dict]:
        out, what = prepare.prepared(image, **steps)
        yield {"width": out.shape[1], "height": out.shape[0], "pixels": out.tobytes(), "what": {k: str(v) for k, v in what.items()}}

    return by_image(pages, rows_of, "width int, height int, pixels binary, what map<string,string>, error string")


def codes(pages: DataFrame) -> DataFrame:
    """IMG9: (name, page, data, type, x0, y0, x1, y1) of the upright EAN and UPC codes of each page."""

    def found(image: np.ndarray) -> Iterator[dict]:
        for data, kind, box in barcodes.scan(image):
            yield {"data": data, "type": kind, **dict(zip(("x0", "y0", "x1", "y1"), map(int, box)))}

    return by_image(pages, found, "data string, type string, x0 int, y0 int, x1 int, y1 int")


def crops(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """IMG12: (name, page, box, width, height, pixels) of the boxes (name, page, box, x0, y0, x1, y1), each page with all of its boxes at once; boxes are cut
    to the page, and empty ones left out."""
    of = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("box", "x0", "y0", "x1", "y1"))).alias("boxes"))
    rows = pages.select(*_INPUT).join(of, PAGE)
    ddl = "name string, page int, box int, width int, height int, pixels binary"
    target = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, page, width, height, pixels, some = (b.column(i)[k].as_py() for i in range(6))
                if pixels is None or not width or not height or len(pixels) % (width * height):
                    continue
                image = np.frombuffer(pixels, np.uint8).reshape(height, width, -1)
                for x in some:
                    part = image[max(0, x["y0"]) : max(0, x["y1"]), max(0, x["x0"]) : max(0, x["x1"])]
                    if part.size:
                        one = {"name": name, "page": page, "box": x["box"], "width": part.shape[1], "height": part.shape[0], "pixels": part.tobytes()}
                        yield pa.RecordBatch.from_pylist([one], schema=target)

    return rows.mapInArrow(run, ddl)


def digit_of(weights: Column) -> Column:
    """REC4, IMG16: struct<digit, confidence> of ten weights: the first greatest, and its share of the exponentials."""
    top = F.array_max(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(F.size(weights) > 0, F.struct((F.array_position(weights, top) - 1).cast("string").alias("digit"), (1 / total).alias("confidence")))


def pieces(texts: DataFrame, vocabulary: DataFrame, unknown: float = -20.0, mark: str = "▁") -> DataFrame:
    """TXT15: (text, pieces): the pieces (piece, score) of a vocabulary whose scores have the greatest sum, for each different text. All stretches of a text that
    could be pieces meet the vocabulary in a join; one pass over a text's ends then keeps the best sum and start of each, and is read back
    from the last. Single characters outside the vocabulary score `unknown`. Of equal sums the longer last piece is taken."""
    longest = vocabulary.agg(F.max(F.length("piece"))).first()[0] or 1
    s = F.concat(F.lit(mark), F.replace("text", F.lit(" "), F.lit(mark)))
    rows = texts.select("text").where("text is not null").distinct().withColumn("s", s)
    ends = rows.select("text", "s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("end"))
    spans = ends.select("text", "s", "end", F.explode(F.sequence(F.greatest(F.lit(0), F.col("end") - longest), F.col("end") - 1)).alias("start"))
    spans = spans.select("text", "start", "end", F.substring(F.col("s"), F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    known = spans.join(vocabulary.select("piece", F.col("score").cast("double").alias("score")), "piece", "left")
    known = known.withColumn("score", F.coalesce("score", F.when(F.col("end") - F.col("start") == 1, F.lit(unknown)))).where("score is not null")
    at_end = known.groupBy("text", "end").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "score"))).alias("ways"))
    lattice = at_end.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("end", "ways"))).alias("ends"))

    def better(state: Column, e: Column) -> Column:
        ways = F.transform(e["ways"], lambda w: F.struct((F.element_at(state, w["start"] + 1)["sum"] + w["score"]).alias("sum"), (-w["start"]).alias("less"), w["piece"].alias("piece")))
        top = F.array_max(F.transform(ways, lambda w: F.struct(w["sum"].alias("sum"), w["less"].alias("less"), w["piece"].alias("piece"))))
        return F.concat(state, F.array(F.struct(top["sum"].alias("sum"), (-top["less"]).cast("int").alias("start"), top["piece"].alias("piece"))))

    nothing = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit("").alias("piece")))
    best = lattice.select("text", F.aggregate("ends", nothing, better).alias("best"))
    start = F.struct(F.size("best").cast("int").alias("at"), F.array().cast("array<string>").alias("out"))

    def back(s: Column, _: Column) -> Column:
        b = F.element_at(F.col("best"), F.greatest(s["at"], F.lit(1)))
        return F.when(s["at"] > 1, F.struct((b["start"] + 1).cast("int").alias("at"), F.concat(F.array(b["piece"]), s["out"]).alias("out"))).otherwise(s)

    return best.select("text", F.aggregate("best", start, back)["out"].alias("pieces"))
