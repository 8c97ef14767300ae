"""JN11, JN13: the most similar of many names by the Ratcliff-Obershelp ratio, with bounds that leave most pairs unscored.

The ratio of two strings is twice the characters they match by the sum of their lengths; no more characters can match than the shorter one has, nor more
than both have of each kind. So, for a ratio of at least `least`:

1. lengths: the shorter is at least least / (2 - least) of the longer;
2. an index over characters (each with the number of its occurrence): of `need` shared ones at least, some are among the (length - need + 1) that are rarest in the names,
   so each string is entered under these only, and strings that share none never meet;
3. of those that meet, twice the shared characters by the sum of lengths is an upper bound, worked out in the JVM;
4. for each probe the pair of the greatest bound is scored first, and then only pairs whose bound reaches that score.

Different probes and different names are compared once each. A probe without characters meets nothing.

Defined cases: null and empty probes and names meet nothing; of equally similar names the first by `ord`, then the least; the ratio isn't symmetric, the
probe comes first; least must be above 0 and at most 1; a name given several times counts by its least ord; an empty side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode


def _tokens(text: Column) -> Column:
    """Each character with the number of its occurrence in the text so far."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c, k: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), k + 1), lambda d: d == c)).cast("string")))


def _need(mine: Column, other: Column, least: float) -> Column:
    """Characters that strings of these lengths share at least; a little less where rounding is in doubt."""
    return F.greatest(F.lit(1), F.ceil(least * (mine + other) / 2 - 1e-9)).cast("int")


def _shortest(length: Column, least: float) -> Column:
    return F.ceil(length * (least / (2 - least)) - 1e-9)


def entered(df: DataFrame, rarity: DataFrame, least: float) -> DataFrame:
    """(text, tokens, n, token): each text under its rarest tokens."""
    rows = df.select("text", _tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    each = rows.select("text", "n", F.explode("tokens").alias("token")).join(rarity, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token")))
    keep = F.col("n") - _need(F.col("n"), _shortest(F.col("n"), least), least) + 1
    prefix = each.groupBy("text", "n").agg(order.alias("o")).select("text", F.explode(F.slice("o", F.lit(1), F.greatest(keep, F.lit(1)).cast("int"))).alias("o"))
    return prefix.join(rows, "text").select("text", "tokens", "n", F.col("o.token").alias("token"))


def bounded(probes: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(probe, name, ord, bound): the pairs whose ratio may be at least `least`. probes: (text); names: (text, ord)."""
    rarity = names.select(F.explode(_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    of = lambda df, x: entered(df, rarity, least).select(F.col("text").alias(x), F.col("tokens").alias(f"{x}_tokens"), F.col("n").alias(f"{x}_n"), "token")
    met = of(probes, "probe").join(of(names.select("text"), "name"), "token")
    met = met.where((F.col("probe_n") >= _shortest(F.col("name_n"), least)) & (F.col("name_n") >= _shortest(F.col("probe_n"), least)))
    shared = F.size(F.array_intersect("probe_tokens", "name_tokens"))
    pairs = met.select("probe", "name", (2.0 * shared / (F.col("probe_n") + F.col("name_n"))).alias("bound")).where(F.col("bound") >= least - 1e-9).distinct()
    return pairs.join(names.select(F.col("text").alias("name"), "ord"), "name").select("probe", "name", "ord", "bound")


def best(spark: SparkSession, probes: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(probe, name, ratio) of each different probe (probe) that has a name (name, ord) with a ratio of at least `least`."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    some = probes.select(F.col("probe").alias("text")).where("text <> ''").distinct()
    known = names.where("name <> ''").groupBy(F.col("name").alias("text")).agg(F.min("ord").alias("ord"))
    pairs = bounded(some, known, least)
    first = pairs.groupBy("probe").agg(F.max(F.struct("bound", F.struct((-F.col("ord")).alias("less")), "name")).alias("f")).select("probe", "f.name", "f.bound")
    first = first.withColumn("reached", decode.ratio_column("probe", "name"))
    open_ = pairs.join(first.select("probe", "reached"), "probe").where(F.col("bound") >= F.greatest(F.col("reached"), F.lit(least)) - 1e-9)
    scored = open_.withColumn("ratio", decode.ratio_column("probe", "name")).where(F.col("ratio") >= least)
    top = F.min(F.struct((-F.col("ratio")).alias("less"), "ord", "name")).alias("t")
    return scored.groupBy("probe").agg(top).select("probe", F.col("t.name").alias("name"), (-F.col("t.less")).alias("ratio"))


def scored_pairs(probes: DataFrame, names: DataFrame, least: float) -> int:
    """How many pairs best() scores at most: for a look at what the bounds are worth."""
    some = probes.select(F.col("probe").alias("text")).where("text <> ''").distinct()
    return bounded(some, names.groupBy(F.col("name").alias("text")).agg(F.min("ord").alias("ord")), least).count()
