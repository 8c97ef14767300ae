"""The bucketed registry and the index over its files."""

import pytest
from pyspark.sql import functions as F

from inkplan.operators import buckets, store

ROWS = "cin string, nom string, seq long"


def key(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, n: int, seq: int = 0, start: int = 0):
    return spark.range(start, start + n).select(F.format_string("%06d", "id").alias("cin"), F.concat(F.lit("n"), F.col("id") + seq).alias("nom"), F.lit(seq).cast("long").alias("seq"))


def test_upsert_writes_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(table(spark, 2000), path, ["cin"], "seq", 64)
    before = buckets.state(spark, path)["where"]
    new = spark.createDataFrame([("000007", "old", 1), ("000007", "new", 2), ("999999", "added", 1), (None, "no key", 1)], ROWS)
    touched = buckets.upsert(new.withColumn("extra", F.lit(1)), path)
    after = buckets.state(spark, path)["where"]
    assert {int(k) for k in after if after[k] != before.get(k)} == set(touched) and len(touched) <= 3
    assert key(buckets.current(spark, path).na.fill("-")) == key(store.upserted(table(spark, 2000), new, ["cin"], "seq").na.fill("-"))
    buckets.upsert(spark.createDataFrame([(None, "again", 5)], ROWS), path)  # null keys are equal
    assert [r.nom for r in buckets.current(spark, path).where("cin is null").collect()] == ["again"]
    assert buckets.upsert(new.limit(0), path) == [] and buckets.state(spark, path)["n"] == 2
    want = key(buckets.current(spark, path).na.fill("-"))
    assert buckets.vacuumed(spark, path) == 0 + len({*before.values(), *after.values()} - set(buckets.state(spark, path)["where"].values()))
    assert key(buckets.current(spark, path).na.fill("-")) == want


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(table(spark, 300), path, ["cin"], "seq", 8)
    seen = buckets.state(spark, path)
    buckets.upsert(spark.createDataFrame([("000001", "first", 1)], ROWS), path, seen)
    with pytest.raises(buckets.Conflict):
        buckets.upsert(spark.createDataFrame([("000001", "second", 2)], ROWS), path, seen)
    names = lambda: {r.cin: r.nom for r in buckets.current(spark, path).where("cin < '000003'").collect()}
    assert names() == {"000000": "n0", "000001": "first", "000002": "n2"}
    with pytest.raises(buckets.Conflict):
        buckets.create(table(spark, 3), path, ["cin"], "seq", 8)
    calls = []

    def make(now):
        if not calls:  # another writer comes in between
            buckets.upsert(spark.createDataFrame([("000002", "between", 3)], ROWS), path)
        calls.append(now["n"])
        return spark.createDataFrame([("000001", "second", 4)], ROWS)

    buckets.retried(make, spark, path)
    assert calls == [1, 2] and names() == {"000000": "n0", "000001": "second", "000002": "between"}


def test_lookups_read_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(table(spark, 4000), path, ["cin"], "seq", 256)
    asked = [f"{k * 97:06d}" for k in range(20)]
    got = buckets.by_key(spark, path, [(k,) for k in [*asked, "nobody"]])
    assert key(got) == key(buckets.current(spark, path).where(F.col("cin").isin(asked))) and len(got.inputFiles()) <= 25
    # By a column that the buckets don't know: files in no order of it.
    files = buckets.current(spark, path)
    found = buckets.index(files, ["nom", "seq"]).cache()
    names = [f"n{k * 191}" for k in range(20)]
    few = buckets.candidates(found, "nom", [*names, "n-1", None])
    assert len(few) < 0.1 * len(files.inputFiles())
    assert key(buckets.looked_up(files, found, "nom", [*names, None])) == key(files.where(F.col("nom").isin(names)))
    assert buckets.looked_up(files, found, "nom", ["nobody"]).count() == 0 == buckets.looked_up(files, found, "nom", []).count()
    with pytest.raises(ValueError):
        buckets.candidates(found, "nom", list(range(buckets.MOST_KEYS + 1)))
