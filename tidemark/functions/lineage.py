"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: A query's own shuffle files go when it ends; nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of an action; then it is what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table of its own in the shared folder.

    A lost executor costs nothing that is written. The table goes when the application
    ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/tidemark-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what ``checkpoint`` wrote for tables that nothing reads any more."""
    for table in tables:
        path = table.__dict__.pop("_written", None)
        if path:
            files, at = _file_system(table.sparkSession, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)
