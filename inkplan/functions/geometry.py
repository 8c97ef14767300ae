"""Boxes and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(box: Column) -> Column:
    """GEO1: struct<x0, y0, x1, y1> around a polygon; zeros for fewer than two points."""

    def side(k: int, end) -> Column:
        all_k = F.when(F.size(box) >= 2, F.transform(box, lambda p: p[k].cast("double")))  # once for both ends, as the condition looks at it too
        return F.when(all_k.isNotNull(), end(all_k)).otherwise(0.0)

    return F.struct(side(0, F.array_min).alias("x0"), side(1, F.array_min).alias("y0"), side(0, F.array_max).alias("x1"), side(1, F.array_max).alias("y1"))


def distance(a: Column, b: Column) -> Column:
    """GEO2: Manhattan distance of the centres of two rectangles."""
    return F.abs((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2) + F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)


def to_pixels(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """GEO3: fractions of a page to whole pixels inside it, at least one wide and high."""
    left = F.greatest(F.lit(0), F.least((x0 * width).cast("int"), width - 1))
    top = F.greatest(F.lit(0), F.least((y0 * height).cast("int"), height - 1))
    right = F.greatest(left + 1, F.least((x1 * width).cast("int"), width))
    bottom = F.greatest(top + 1, F.least((y1 * height).cast("int"), height))
    return F.struct(left.alias("px0"), top.alias("py0"), right.alias("px1"), bottom.alias("py1"))


def int_box(polygon: Column) -> Column:
    """GEO9: points of a polygon as whole pixels, halves to even; an empty box where it isn't one of pairs."""
    pairs = F.forall(polygon, lambda p: F.coalesce(F.size(p) == 2, F.lit(False)) & ~F.exists(p, lambda x: x.isNull()))
    points = F.transform(polygon, lambda p: F.transform(p, lambda x: F.bround(x, 0).cast("int")))
    return F.when(polygon.isNotNull() & pairs, points).otherwise(F.array().cast("array<array<int>>"))


def clockwise(polygon: Column) -> Column:
    """GEO8: four points in the order top left, top right, bottom right, bottom left: those of least and greatest x + y, and of least and greatest
    y - x; of equals the first."""

    def pick(by, least: bool) -> Column:
        keyed = F.transform(polygon, lambda p, k: F.struct((by(p) if least else -by(p)).alias("d"), k.alias("k")))
        return F.get(polygon, F.array_min(keyed)["k"])

    total, across = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    return F.array(pick(total, True), pick(across, True), pick(total, False), pick(across, False))


def crop_size(polygon: Column) -> Column:
    """GEO8: struct<width, height> of the upright crop of a quadrilateral: its longer sides."""
    corner = clockwise(polygon)

    def side(a: int, b: int) -> Column:
        p, q = F.get(corner, F.lit(a)), F.get(corner, F.lit(b))
        return F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))

    size = lambda a, b: F.floor(F.greatest(a, b)).cast("int")
    return F.struct(size(side(0, 1), side(2, 3)).alias("width"), size(side(0, 3), side(1, 2)).alias("height"))


def clamp(c: Column) -> Column:
    """MTH1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
