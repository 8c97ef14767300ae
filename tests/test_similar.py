"""The most similar name with bounds, against every pair."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from inkplan.operators import fields, similar


def plain(probes, names, least):
    out = {}
    for p in {p for p in probes if p}:
        rated = [(-SequenceMatcher(None, p, n).ratio(), k, n) for k, n in enumerate(names) if n]
        found = min(rated, default=(0.0, 0, ""))
        if -found[0] >= least:
            out[p] = (found[2], -found[0])
    return out


def found(spark, probes, names, least):
    rows = similar.best(spark, spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, ord int"), least).collect()
    assert len({r.probe for r in rows}) == len(rows)
    return {r.probe: (r.name, pytest.approx(r.ratio)) for r in rows}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.72, 0.9, 1.0])
def test_against_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    names = [word() for _ in range(60)] + ["", None, "aaaa", "aaab"]
    probes = [word() for _ in range(30)] + [n[:-1] + "x" for n in names[:15] if n] + ["", None, names[0], names[0], "zzz", "aaaa"]
    assert found(spark, probes, names, least) == plain(probes, names, least)


def test_acronyms_and_empty_sides(spark):
    probes = ["ENI7", "ENSI", "FST", "QQQQ", "ISET RADES", "x"]
    assert found(spark, probes, fields.SCHOOLS, fields.SCHOOL_RATIO) == plain(probes, fields.SCHOOLS, fields.SCHOOL_RATIO)
    assert found(spark, [], ["a"], 0.5) == {} == found(spark, ["a"], [], 0.5)
    with pytest.raises(ValueError):
        found(spark, ["a"], ["a"], 0.0)


def test_few_pairs_are_scored(spark, sf_dir):
    """Part names and types with slips, against all part names and brands and all customers' names."""
    larger = sf_dir.replace("0.001", "0.01")
    parts = spark.read.parquet(f"{larger}/part.parquet")
    named = parts.select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).union(spark.read.parquet(f"{larger}/customer.parquet").select("c_name")).distinct()
    names = [r[0] for r in named.orderBy("name").collect()]
    probes = [r[0] for r in parts.select("p_type").union(parts.select(F.concat(F.col("p_name"), F.lit(" Brand#1"), (F.col("p_partkey") % 7).cast("string")))).distinct().orderBy("p_type").collect()][:60]
    want = plain(probes, names, 0.9)
    assert found(spark, probes, names, 0.9) == want and len(want) > 20
    pairs = similar.scored_pairs(spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, ord int"), 0.9)
    assert pairs < 0.05 * len(probes) * len(names)
    customers = [n for n in names if n.startswith("Customer")]
    types = sorted({r[0] for r in parts.select("p_type").collect()})
    assert found(spark, types, customers, 0.72) == plain(types, customers, 0.72)
    assert similar.scored_pairs(spark.createDataFrame([(p,) for p in types], "probe string"), spark.createDataFrame([(n, k) for k, n in enumerate(customers)], "name string, ord int"), 0.72) < 0.05 * len(types) * len(customers)
