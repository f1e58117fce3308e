"""Tables on disk: reading with a schema, replacing one as a whole, and replacing some of its keys in place."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.state import settle

BUCKET = "_bucket"


def _found(spark: SparkSession, read) -> DataFrame | None:
    """What `read` gives, or None where nothing has been written yet."""
    try:
        return read(spark.read)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The newest version of a table, empty if there is none."""
    pointers = _found(spark, lambda r: r.text(f"{root}/{name}/_current-*"))
    newest = pointers.agg(F.max("value").alias("v")).first().v if pointers is not None else None
    return spark.read.schema(schema).parquet(f"{root}/{name}/{newest}") if newest else spark.createDataFrame([], schema)


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a version of a table, be it an empty one, has been written to its end."""
    pointers = _found(spark, lambda r: r.text(f"{root}/{name}/_current-*"))
    return pointers is not None and not pointers.isEmpty()


def replace_table(df: DataFrame, root: str, name: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Write a new version beside the old ones, then a pointer of its own name: readers take the newest pointer that is there, so they see the old version or the
    new one, and nothing is deleted under them."""
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{root}/{name}/{version}")
    df.sparkSession.createDataFrame([(version,)], "value string").coalesce(1).write.text(f"{root}/{name}/_current-{version}")


class KeyedTable:
    """A Parquet table in folders by a hash of `by`, of which changes rewrite only the folders that they touch.

    `by` is the column whose rows change together: the key itself for upserts, the family for families. What a touched folder will hold is written to the shared folder first and
    put in its place by a dynamic partition overwrite, so a job that fails on the way can be run again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.by, self.buckets = spark, path, schema, by, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.by).cast("string")), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        empty = self._placed(self.spark.createDataFrame([], self.schema))
        found = _found(self.spark, lambda r: r.schema(empty.schema).parquet(self.path))
        return empty if found is None else found

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        """`rows` as the whole of the folders `touched`; folders that come out empty are written as such."""
        rows = settle(rows.repartition(max(1, len(touched)), BUCKET))
        kept = {r[BUCKET] for r in rows.select(BUCKET).distinct().collect()}  # one for each bucket at most
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for b in sorted(set(touched) - kept):
            rows.limit(0).drop(BUCKET).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={b}")

    def upsert(self, rows: DataFrame, key: list[str]) -> None:
        """`rows` (of unique keys, `by` among their columns) in place of those with equal keys."""
        self._change(rows, rows.select(*key), key)

    def replace(self, families: DataFrame, rows: DataFrame) -> None:
        """All rows of `families` (column `by`) go, `rows` come."""
        self._change(rows, families.select(self.by).distinct(), [self.by])

    def _change(self, rows: DataFrame, gone: DataFrame, key: list[str]) -> None:
        rows = settle(self._placed(rows.select(*self.spark.createDataFrame([], self.schema).columns)))
        gone = settle(gone)
        asked = rows.select(BUCKET) if self.by not in gone.columns else rows.select(BUCKET).union(self._placed(gone).select(BUCKET))
        touched = sorted(r[BUCKET] for r in asked.distinct().collect())
        if not touched:
            return
        old = self._stored().filter(F.col(BUCKET).isin(touched)).join(gone.hint("merge"), key, "left_anti")
        self._put(old.unionByName(rows), touched)
