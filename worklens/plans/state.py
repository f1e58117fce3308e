"""Intermediate tables of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_settled: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`). Where it is unset, a folder of our own, in local mode only: on a cluster every
    executor would write to a disk of its own, and rows would be lost."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-settled-"))
    return _own[0]


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and gives later joins true sizes. What was shuffled for it goes from the executors' disks with the end of the write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete the settled tables that these read, and nothing else: for plans that know that nobody reads them any more."""
    for df in tables:
        names = {file.rstrip("/").split("/")[-2] for file in df.inputFiles()}
        gone = [path for path in _settled if path.rpartition("/")[2] in names]
        _delete(df.sparkSession, gone)
        _settled[:] = [path for path in _settled if path not in gone]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, what settle() writes is deleted at the end: for plans whose results are written inside. A DataFrame that still reads settled tables can't be used afterwards.

    Settled tables otherwise stay, as a DataFrame that was returned may read them at any time; the folder's owner clears it."""
    before = set(_settled)
    try:
        yield
    finally:
        new = [path for path in _settled if path not in before]
        _delete(spark, new)
        _settled[:] = [path for path in _settled if path not in new]
