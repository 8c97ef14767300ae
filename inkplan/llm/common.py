"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id wherever documents are ordered: such rows come first.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly (doc_id long, text string, never null): other columns can't clash."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    )


def keyed(df: DataFrame) -> DataFrame:
    """As id_text(), with a missing doc_id replaced by NO_ID so that it can be a join key."""
    return df.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def text_key(column: str = "text") -> Column:
    """With the doc_id, what tells a text from others of the same doc_id, and what orders these: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def texts(df: DataFrame) -> DataFrame:
    """(doc_id, text, key) as keyed(), with the text's key."""
    return keyed(id_text(df)).withColumn("key", text_key())


def unkeyed(column: str = "doc_id") -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(column)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: What operators keep in a worker between tasks, by name, and how to let go of it.
HELD: dict[str, Callable[[], None]] = {}


def let_go(but: str | None = None) -> None:
    """Frees what other operators keep in this worker, and gives what earlier tasks freed back to the system: workers are reused, and their
    memory adds up over the stages of a pipeline."""
    for name, drop in HELD.items():
        if name != but:
            drop()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str, holds: str | None = None, by: int | None = None) -> DataFrame:
    """Python over Arrow batches. make() runs once in each task and returns a function from a pyarrow RecordBatch to a dict of columns
    (lists or arrays) of any length. holds: the name in HELD of what make() uses. by: the number of a string or binary column;
    then make()'s function gets slices() of a batch, so that memory depends on neither the batch nor the number of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)
        each, target = make(), None
        for batch in batches if by is None else slices(batches, by=by):
            if not batch.num_rows:
                continue
            out = each(batch)
            target = target or arrow_schema(schema)
            made = pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in target], schema=target
            )
            if made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, by: int | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that few texts at a time become Python objects; by: the number of a string or binary column,
    of which a piece holds some `most` bytes, or one row."""
    for batch in batches:
        size = None if by is None else np.cumsum(pc.binary_length(batch.column(by)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = min(at + rows, batch.num_rows)
            if size is not None:
                end = min(end, max(at + 1, int(np.searchsorted(size, most + (size[at - 1] if at else 0), "right"))))
            yield batch.slice(at, end - at)
            at = end


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "float": pa.float32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Of a flat DDL string such as 'a long, b string'."""
    return pa.schema([(n, _TYPES[t]) for n, t in (part.strip().split(" ", 1) for part in ddl.split(","))])


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared checkpoint folder and read again: lineage ends there, and lost
    executors cost no recomputation of what went before. The folder goes with the session, or by release()."""
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_runs: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """Where this application stores what it reads again."""
    path = f"{shared_dir(spark)}/inkplan/{spark.sparkContext.applicationId}"
    if path not in _runs:
        _runs.add(path)
        atexit.register(release, spark)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all that this application has stored. Results of operators that haven't been written or collected can't be read after it, so it is for
    the end of a run, or between runs of a long session."""
    context = spark.sparkContext
    if context._jsc is None:  # stopped
        return
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inkplan/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    import tempfile

    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/inkplan-checkpoints"
