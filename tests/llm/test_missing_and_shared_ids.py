"""Operators 8 to 10 against their SQL on rows without a doc_id, rows that share one, repeated rows and texts of several lengths; and the sizes of bit filters."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from inkplan.llm import neardup, registry

NAMES = ["op8_near_duplicates", "op9_suffix_dedup", "op10_super_kmers"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = [prose(90) for _ in range(5)], prose(50)
    rows = [(None, base[0]), (None, base[0]), (None, base[1]), (None, None), (None, ""), (7, base[0]), (7, base[1]), (7, base[1]), (7, base[2] + " tail"), (7, None), (3, base[2]), (3, passage), (3, passage + " " + passage)]
    rows += [(k, f"{prose(20)} {passage} {prose(20)}") for k in (1, 5, 5, None, None, 9)] + [(11, "é" * 120), (None, "é" * 120), (12, "x y " * 60), (8, base[3] + " end"), (None, base[3]), (None, base[4]), (None, base[4] + " more")]
    rng.shuffle(rows)
    path = tmp_path_factory.mktemp("ids")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(path / "documents.parquet"))
    return path


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(folder)).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_component_of_rows_with_and_without_id(spark, folder):
    rows = registry.QUERIES["op8_near_duplicates"](spark, str(folder)).where("n_shingles > 60").collect()
    assert any(r.doc_id is None and r.component_id == 7 and not r.kept for r in rows)  # a copy of a row that has an id
    alone = [r for r in rows if r.component_id is None]
    assert alone and all(r.doc_id is None for r in alone) and any(not r.kept for r in alone)


def test_filters_grow_with_their_keys(spark, monkeypatch):
    assert [neardup.filter_bits(n) for n in (0, 1 << 19, (1 << 19) + 1, 10**7, 10**9)] == [1 << 23, 1 << 23, 1 << 24, 1 << 28, 1 << 28]
    df = spark.range(4000).select("id", F.lit("x").alias("_key0"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"))
    ids = spark.range(0, 4000, 7).select(F.col("id").alias("doc"))
    want = {i for i in range(0, 4000, 7) if i % 3}
    for most in (neardup.MOST_KEYS, 10):
        monkeypatch.setattr(neardup, "MOST_KEYS", most)
        some = {r.id for r in neardup.maybe_in(df, ids, ("k",), ("doc",)).collect()}
        flags = {r.id: r.hit for r in neardup.maybe_in(df, ids, ("k",), ("doc",), "hit").collect()}
        assert want <= some and len(some) < len(want) + 40 and len(flags) == 4000 and {i for i, f in flags.items() if f} == some
    assert some == want  # joined: no strangers
