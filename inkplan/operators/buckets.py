"""SET2, SET3, SNK8, REG1, REG2: a registry in hash buckets, changed bucket by bucket, and an index over files for lookups by other columns.

A table is a folder: data/<version>/_bucket=<k>/ holds rows whose key falls into bucket k, and manifests/<n>.json says which version of each bucket
belongs to the table's state n. upsert() reads and writes the buckets of its keys only, and commits by putting manifest n + 1 in place once: of two
writers that began with the same state the second is refused (Conflict), has changed nothing, and may begin again. Readers take the newest manifest, so
they see a state whole; the states before stay until vacuumed().

index() keeps, for each file of a table and each of some columns, the least and the greatest value and a bit filter of all values; candidates() are the
files that may hold some of the keys asked for, found by a join on filter words, and looked_up() reads these alone.

Defined cases: of several new rows of one key the last by order stays, of equal order the greatest row; keys may be null (nulls are equal); an upsert without
rows commits nothing; columns of new rows that the table doesn't have are left out, missing ones are null; a lookup of no keys, or of null, finds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import commits

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer has committed since."""


def _number(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def state(spark: SparkSession, path: str) -> dict:
    found = [n for n in commits.names(spark, f"{path}/manifests") if n.endswith(".json")]
    if not found:
        raise FileNotFoundError(path)
    return json.loads(commits.text(spark, f"{path}/manifests/{found[-1]}"))


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    if not commits.put_once(spark, f"{path}/manifests/{manifest['n']:012d}.json", json.dumps(manifest)):
        raise Conflict(f"state {manifest['n']} of {path} is there already")


def _last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, by partial aggregates."""
    rest = F.struct(F.col(order).alias("_order"), F.struct(*[c for c in rows.columns]).alias("_row"))
    return rows.groupBy(*keys).agg(F.max(rest).alias("_last")).select("_last._row.*")


def _write(rows: DataFrame, path: str, version: str, keys: list[str], buckets: int) -> None:
    rows.withColumn(BUCKET, _number(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{version}")


def _written(spark: SparkSession, path: str, version: str) -> list[int]:
    return [int(n.removeprefix(f"{BUCKET}=")) for n in commits.names(spark, f"{path}/data/{version}") if n.startswith(f"{BUCKET}=")]


def create(df: DataFrame, path: str, keys: list[str], order: str, buckets: int = 256) -> None:
    """A new table of the last row of each key. buckets: fixed from now on; a bucket should stay within a few hundred MB."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    _write(_last(df, keys, order), path, version, keys, buckets)
    where = {str(k): version for k in _written(spark, path, version)}
    _commit(spark, path, {"n": 0, "keys": keys, "order": order, "buckets": buckets, "schema": df.schema.json(), "where": where})


def _read(spark: SparkSession, path: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    folders = [f"{path}/data/{v}/{BUCKET}={k}" for k, v in manifest["where"].items() if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, state(spark, path))


def upsert(new: DataFrame, path: str, based_on: dict | None = None) -> list[int]:
    """The buckets that were written. based_on: a state() read before, on which the new rows depend; the newest by default."""
    spark = new.sparkSession
    manifest = based_on or state(spark, path)
    keys, n = manifest["keys"], manifest["buckets"]
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    rows = new.select(*[(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    last = _last(rows, keys, manifest["order"])
    touched = {r[0] for r in last.select(_number(keys, n)).distinct().collect()}  # buckets, of which there are `buckets` at most
    if not touched:
        return []
    before = _read(spark, path, manifest, touched)
    same = [before[k].eqNullSafe(last[k]) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    version = uuid.uuid4().hex
    _write(before.join(last, condition, "left_anti").unionByName(last), path, version, keys, n)
    where = manifest["where"] | {str(k): version for k in _written(spark, path, version)}
    try:
        _commit(spark, path, manifest | {"n": manifest["n"] + 1, "where": where})
    except Conflict:
        commits.delete(spark, f"{path}/data/{version}")
        raise
    return sorted(touched)


def retried(make, spark: SparkSession, path: str, times: int = 5) -> list[int]:
    """upsert() of make(state), begun again with the newest state after a conflict."""
    for k in range(times):
        now = state(spark, path)
        try:
            return upsert(make(now), path, now)
        except Conflict:
            if k == times - 1:
                raise
    return []


def by_key(spark: SparkSession, path: str, keys: list[tuple]) -> DataFrame:
    """REG2: the rows of some keys; only their buckets are read."""
    manifest = state(spark, path)
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    asked = spark.createDataFrame(keys, T.StructType([schema[k] for k in manifest["keys"]])).distinct()
    only = {r[0] for r in asked.select(_number(manifest["keys"], manifest["buckets"])).distinct().collect()}
    return _read(spark, path, manifest, only).join(asked, manifest["keys"], "left_semi")


def vacuumed(spark: SparkSession, path: str) -> int:
    """Deletes the data and manifests of all states but the newest, for times when nobody reads them. The number of versions that went."""
    kept, gone = state(spark, path), 0
    used = set(kept["where"].values())
    for version in commits.names(spark, f"{path}/data"):
        if version not in used:
            gone += commits.delete(spark, f"{path}/data/{version}")
    for name in commits.names(spark, f"{path}/manifests"):
        if name != f"{kept['n']:012d}.json":
            commits.delete(spark, f"{path}/manifests/{name}")
    return gone


# -- an index over files -------------------------------------------------------------------------

#: Bits of each file's filter and bits set for a value; keys of a lookup at most.
BITS, PROBES, MOST_KEYS = 1 << 21, 4, 10_000


def _probes(value: Column) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(k), value), F.lit(BITS)) for k in range(PROBES)]))


def index(df: DataFrame, columns: list[str]) -> DataFrame:
    """(file, column, least, greatest, number, bits) of a table read from files: a row for each filter word of 32,768 bits. Values are compared as text."""
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c"))
    rows = rows.select("file", "c.*").where("value is not null")
    zones = rows.groupBy("file", "column").agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
    bits = rows.select("file", "column", F.explode(_probes(F.col("value"))).alias("p"))
    bits = bits.groupBy("file", "column", F.bitmap_bucket_number("p").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    return bits.join(zones, ["file", "column"])


def candidates(found: DataFrame, column: str, keys: list) -> list[str]:
    """The files of an index() that may hold one of the keys. At most MOST_KEYS keys are sent; the answer is bounded by the number of files."""
    keys = sorted({str(k) for k in keys if k is not None})
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: join with the table instead")
    if not keys:
        return []
    asked = found.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    probes = asked.select("key", _probes(F.col("key")).alias("p")).select("key", F.size("p").alias("of"), F.explode("p").alias("p"))
    probes = probes.select("key", "of", F.bitmap_bucket_number("p").alias("number"), F.bitmap_bit_position("p").alias("at"))
    met = found.where(F.col("column") == column).join(F.broadcast(probes), "number").where("key >= least and key <= greatest")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = met.where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
    whole = hit.groupBy("file", "key").agg(F.count("*").alias("n"), F.first("of").alias("of")).where("n = of")
    return sorted(r.file for r in whole.select("file").distinct().collect())


def looked_up(df: DataFrame, found: DataFrame, column: str, keys: list) -> DataFrame:
    """The rows of df, a table read from files, whose column has one of the keys: only candidate files are read."""
    files, some = candidates(found, column, keys), [k for k in keys if k is not None]
    rows = df.sparkSession.read.schema(df.schema).parquet(*files) if files else df.limit(0)
    return rows.where(F.col(column).isin(some)) if some else rows.limit(0)


