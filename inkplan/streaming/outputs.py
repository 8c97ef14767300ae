"""STR4, SRC2: accepted and refused rows of a batch under one commit, with the number of attempts and a way back in.

A batch writes both outputs to folders of its own and then, by one rename, a manifest that names them; readers see the folders that manifests name and
nothing else. A batch that is run again after a failure finds its manifest and does nothing, or finds none and writes new folders; what a broken run left
behind is named nowhere, and swept() deletes it. again() sends the refused rows that have attempts left through the judge once more: its manifest
names the new outputs and the refused folders that they replace, so no row is lost or doubled at any point.

Defined cases: a batch without rows commits empty outputs; a row for which the judge gives no error is accepted; columns `error` and `attempts` belong
to this module and are replaced where rows have them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import commits

MOST_ATTEMPTS = 3
#: Takes rows and gives them back with a string column `error`, null where a row is accepted.
Judge = Callable[[DataFrame], DataFrame]


def manifests(spark: SparkSession, target: str) -> list[dict]:
    """One small file for each batch, in order of commit numbers."""
    names = [n for n in commits.names(spark, f"{target}/manifests") if n.endswith(".json")]
    if not names:
        return []
    lines = spark.read.option("wholetext", True).text([f"{target}/manifests/{n}" for n in names]).collect()
    return sorted((json.loads(r.value) for r in lines), key=lambda m: m["batch"])


def commit(spark: SparkSession, rows: DataFrame, judge: Judge, target: str, batch: str, replaces: list[str] | None = None, between: Callable[[], None] = lambda: None) -> bool:
    """Judges the rows and commits both outputs; whether this run did. between: called between the two writes, for tests."""
    if commits.exists(spark, f"{target}/manifests/{batch}.json"):
        return False
    before = F.coalesce(F.col("attempts"), F.lit(0)) if "attempts" in rows.columns else F.lit(0)
    judged = judge(rows.withColumn("attempts", (before + 1).cast("int")).drop("error"))
    mark = uuid.uuid4().hex
    names = {"accepted": f"accepted/{batch}-{mark}", "refused": f"refused/{batch}-{mark}"}
    judged = judged.persist()  # one judging for both outputs
    try:
        judged.where("error is null").drop("error").write.parquet(f"{target}/{names['accepted']}")
        between()
        judged.where("error is not null").write.parquet(f"{target}/{names['refused']}")
    finally:
        judged.unpersist()
    return commits.put_once(spark, f"{target}/manifests/{batch}.json", json.dumps({"batch": batch, **names, "replaces": replaces or []}))


def start(spark: SparkSession, stream: DataFrame, judge: Judge, target: str, checkpoint: str) -> StreamingQuery:
    """Each batch of the stream under its number."""

    def write(df: DataFrame, n: int) -> None:
        commit(df.sparkSession, df, judge, target, f"{n:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, target: str, kind: str) -> tuple[DataFrame | None, list[str]]:
    found = manifests(spark, target)
    gone = {name for m in found for name in m["replaces"]}
    names = [m[kind] for m in found if m[kind] not in gone]
    parts = [spark.read.parquet(f"{target}/{n}") for n in names]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None), names


def accepted(spark: SparkSession, target: str) -> DataFrame | None:
    """All accepted rows so far; None before the first commit."""
    return _read(spark, target, "accepted")[0]


def refused(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows that are refused so far, with `error` and `attempts`."""
    return _read(spark, target, "refused")[0]


def again(spark: SparkSession, judge: Judge, target: str, batch: str, most: int = MOST_ATTEMPTS) -> bool:
    """Sends refused rows with attempts left through the judge again, under a batch name of its own; those without stay refused as they are."""
    rows, names = _read(spark, target, "refused")
    if rows is None:
        return False
    held = rows.withColumn("_last", F.struct("error", "attempts"))

    def judge_open(df: DataFrame) -> DataFrame:
        may = df["_last.attempts"] < most
        tried = judge(df.where(may).drop("_last"))
        spent = df.where(~may).withColumn("error", F.col("_last.error")).withColumn("attempts", F.col("_last.attempts")).drop("_last")
        return tried.unionByName(spent, allowMissingColumns=True)

    return commit(spark, held, judge_open, target, batch, names)


def swept(spark: SparkSession, target: str) -> int:
    """Deletes folders that no manifest names, or that another has replaced: for times when no batch is running. The number of them."""
    found = manifests(spark, target)
    gone = {name for m in found for name in m["replaces"]}
    kept, n = {m[k] for m in found for k in ("accepted", "refused")} - gone, 0
    for kind in ("accepted", "refused"):
        for name in commits.names(spark, f"{target}/{kind}"):
            if f"{kind}/{name}" not in kept:
                n += commits.delete(spark, f"{target}/{kind}/{name}")
    return n
