"""STR1: a folder of result files as a stream; progress is a query over what has been written."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.batches import job_counters


def start(spark: SparkSession, source: str, schema, process, target: str, checkpoint: str) -> StreamingQuery:
    """Each new file under source goes through process (DataFrame to DataFrame) and is appended under target, once: batches that were written
    before a failure are written over, by their number."""

    def write(df: DataFrame, batch: int) -> None:
        process(df).withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local folder of our own for local sessions only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/inkplan-streams"


def progress(spark: SparkSession, target: str) -> DataFrame:
    """STR3 over the results so far (job_id, status)."""
    return job_counters(spark.read.parquet(target))


def windowed(events: DataFrame, late: str = "10 minutes", length: str = "30 minutes") -> DataFrame:
    """Counts of events by type and window with a watermark; ts without a zone is taken as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
