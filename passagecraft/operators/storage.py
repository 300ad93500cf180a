"""Folders that driver and executors share, and what is written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a single process without one a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="passagecraft-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def store_of(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    p = hadoop_path(spark, path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, store.makeQualified(p)


def delete(spark: SparkSession, path: str) -> None:
    store, p = store_of(spark, path)
    store.delete(p, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is there when the driver ends goes."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    store, p = store_of(spark, path)
    store.mkdirs(p)
    store.deleteOnExit(p)
    return path


def kept(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read back, so that two uses of it are one computation; gone when the driver ends."""
    path = f"{scratch(df.sparkSession, what)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """A setting for an application on texts: rows go to Python workers ``rows`` at a time. Operators leave the session as it is; the named queries call this."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, such as a manifest; null if there is none."""
    store, p = store_of(spark, path)
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file in place as a whole, under a name that nothing has yet; whether that was so."""
    store, p = store_of(spark, path)
    if store.exists(p):
        return False
    store.mkdirs(p.getParent())
    staged = hadoop_path(spark, f"{p.getParent().toString()}/_new-{uuid.uuid4().hex}")
    stream = store.create(staged, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not store.exists(p) and store.rename(staged, p):
        return True
    store.delete(staged, False)
    return False
