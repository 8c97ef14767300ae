"""The document registry: upserts, statistics, archive paths."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upserted(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SET2, SET3: current without the keys of new, and the last row of each key of new. Parquet has no MERGE; put the result
    in place by replace()."""
    last = last_of_each(new, keys, order)
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*current.columns))


def upsert_counts(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """AGG15: how many keys an upsert adds and how many it changes."""
    given = new.select(*keys).distinct().join(current.select(*keys, F.lit(True).alias("_known")).distinct(), keys, "left")
    return given.agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if(F.col("_known").isNotNull()).alias("updated"))


def replace(df: DataFrame, path: str) -> None:
    """REG1: writes df as the new version of a table: all of it in a folder of its own, then the pointer to it, by one rename that takes the old
    pointer's place. Readers through current() see the old version or the new one, whole; the version before stays for those that still read it."""
    spark, version = df.sparkSession, f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    new, pointer = hadoop.Path(f"{path}/_{version}"), hadoop.Path(f"{path}/_current")
    fs = new.getFileSystem(conf)
    before = _versions(fs, hadoop, path)
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(pointer), options)
    for old in before[:-2]:
        fs.delete(hadoop.Path(f"{path}/{old}"), True)


def _versions(fs, hadoop, path: str) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop.Path(path)) if s.getPath().getName().startswith("v-"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that replace() last put in place."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    stream = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).open(pointer)
    version = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return spark.read.parquet(f"{path}/{version}")


def statistics(docs: DataFrame) -> DataFrame:
    """AGG7: one pass over (encrypted, status, match_score); a mean of exactly 0 is null (T14)."""
    return docs.agg(
        F.count("*").alias("total"), F.count_if("encrypted").alias("encrypted"), F.count_if(F.col("status") == "review").alias("pending_review"),
        F.nullif(F.round(F.avg("match_score"), 2), F.lit(0.0)).alias("avg_match_score"),
    )


def fingerprint(content: Column) -> Column:
    """SEC1."""
    return F.sha2(content, 256)


def archive_path(barcode: Column, cin: Column, identifier: Column, session_year: Column, stamp: str, extension: Column, this_year: str) -> Column:
    """SNK7: year/id_stamp.ext; the id is the barcode, else the CIN, else the identifier."""
    first = F.coalesce(F.nullif(barcode, F.lit("")), F.nullif(cin, F.lit("")), F.nullif(identifier, F.lit("")), F.lit("INCONNU"))
    year = F.when(F.coalesce(session_year, F.lit("")).rlike(r"^\s*\d{4}(?:[/-]\d{4})?\s*$"), F.substring(F.trim(session_year), 1, 4)).otherwise(this_year)
    return F.concat(year, F.lit("/"), text.safe_token(first), F.lit(f"_{stamp}"), F.lower(extension))


def newest_first(docs: DataFrame, most: int) -> DataFrame:
    """SRT3."""
    return docs.orderBy(F.desc("created_at"), "sha256").limit(most)


__all__ = ["dates", "upserted", "last_of_each", "replace", "statistics", "fingerprint", "archive_path", "newest_first"]
