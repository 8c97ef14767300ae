"""Means that don't depend on the order of their sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean4(column: Column) -> Column:
    """An aggregate: the mean to four places, halves up, of values with six places at most; null without values. The sum is one of whole
    millionths, so that any order of the rows and either engine give the same."""
    millionths, n = F.sum(F.round(column * 1_000_000).cast("long")), F.count(column)
    return F.when(n > 0, F.floor((2 * millionths + 100 * n) / (200 * n)) / 10_000.0)
