"""Small files that are put in place once: what several writers agree by."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.delete(at, True)


def text(spark: SparkSession, path: str) -> str:
    fs, at = place(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a file whole, or not at all: False if there is one of that name. A rename decides that doesn't take a file's place, so of several writers one
    wins (on HDFS and like stores at once; a local folder looks first, then renames)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, at = place(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_draft-{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(at), none)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True
