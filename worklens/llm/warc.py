"""WARC archives with a Merkle fixity audit.

Pages become WARC records, dealt to files by hash; in a file they follow each other by id, and the manifest holds each record's
number, offset and length. A tree over a file hashes each record, then each run of `FAN` neighbouring nodes with
their offset ranges, up to one root. Two replicas are compared root by root; only where hashes differ are the children
compared, down to the records that are damaged or lost.

Everything is DataFrame operations. Cases: a null url or html counts as empty; rows with a null id come first in their
file. Repeated rows are records of their own. A replica that lacks a record or a file shows it as `missing`; what only the
replica has shows as `extra`. No pages, no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

FAN = 16
FILE_BYTES = 64 << 20
END = "\r\n\r\n"


def record_text(id_col="page_id", url_col="url", body_col="html") -> Column:
    """A page as a WARC record, without the empty line that ends it."""
    body, url = F.coalesce(F.col(body_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(F.concat_ws("\n", F.col(id_col).cast("string"), url, body), 256),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def placed(rows: DataFrame, *, file_bytes=FILE_BYTES) -> DataFrame:
    """`rows` (id, size, hash, ...) with file, n, begin, end: dealt to files of about `file_bytes`, in the order of ids."""
    total = rows.agg(F.sum("size").alias("n")).first().n or 0
    rows = rows.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // file_bytes)))))
    order = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "hash")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("n", (F.row_number().over(order) - 1).cast("long")).withColumn("end", end)
    return rows.withColumn("begin", F.col("end") - F.col("size")).drop("size")


def manifest(pages: DataFrame, *, id_col="page_id", url_col="url", body_col="html", file_bytes=FILE_BYTES, **hashes: Callable[[Column], Column]) -> DataFrame:
    """id, file, n, begin, end, hash of each page's record, and a column for each further hash of it. Records are hashed where they are read; only the hashes move."""
    record = record_text(id_col, url_col, body_col)
    columns = {k: f(record) for k, f in hashes.items()}
    rows = pages.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(record) + len(END)).cast("long").alias("size"), F.sha2(record, 256).alias("hash"), *[c.alias(k) for k, c in columns.items()])
    return placed(stash(rows), file_bytes=file_bytes)


def records(pages: DataFrame, *, id_col="page_id", url_col="url", body_col="html", file_bytes=FILE_BYTES) -> DataFrame:
    """id, file, n, begin, end, hash, record: the WARC records of `pages` with their places."""
    record = record_text(id_col, url_col, body_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(record) + len(END)).cast("long").alias("size"), F.sha2(record, 256).alias("hash"), record.alias("record"))
    return placed(rows, file_bytes=file_bytes)


def write_warc(recs: DataFrame, path: str) -> None:
    """One folder for each file, its records in order; Spark's text writer ends each with an empty line as WARC asks."""
    placed = recs.repartition("file").sortWithinPartitions("file", "n")
    placed.select("file", "record").write.partitionBy("file").option("lineSep", END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, begin, end, header, body of each record of files that write_warc() wrote, found by Content-Length."""
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            out = []
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, number = 0, int(name.rsplit("file=", 1)[1].split("/")[0])
                while at < len(raw):
                    split = raw.index(b"\r\n\r\n", at)
                    fields = dict(x.split(": ", 1) for x in raw[at:split].decode().split("\r\n")[1:])
                    end = split + 4 + int(fields["Content-Length"])
                    out.append((number, at, end + 4, raw[at:split].decode(), raw[split + 4 : end]))
                    at = end + 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["file", "begin", "end", "header", "body"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, "file long, begin long, end long, header string, body binary")


def tree(leaf: DataFrame, height: int) -> list[DataFrame]:
    """The levels of the trees of all files, leaves first: file, n, begin, end, hash."""
    levels = [stash(leaf.select("file", "n", "begin", "end", "hash"))]
    for _ in range(height):
        child = F.struct("n", "begin", "end", "hash")
        up = levels[-1].groupBy("file", F.expr(f"n div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        text = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["n"], c["begin"], c["end"], c["hash"])), "|")
        up = up.select("file", F.col("up").alias("n"), F.array_min("c.begin").alias("begin"), F.array_max("c.end").alias("end"), F.sha2(text, 256).alias("hash"))
        levels.append(stash(up))
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """file, n, begin, end, finding (changed, missing, extra) for each record in which two replicas' leaves differ."""
    most = first.select("n").union(second.select("n")).agg(F.max("n").alias("n")).first().n
    height = 0
    while most is not None and FAN**height <= most:
        height += 1
    one, two = tree(first, height), tree(second, height)
    suspects = None
    for level in range(height, -1, -1):
        a, b = one[level], two[level]
        if suspects is not None:  # only children of nodes that differ
            a, b = (x.withColumn("up", F.expr(f"n div {FAN}")).join(suspects.hint("merge"), ["file", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.alias("a").join(b.hint("merge").alias("b"), ["file", "n"], "full")
        differ = both.filter(~F.expr("a.hash <=> b.hash and a.begin <=> b.begin and a.end <=> b.end"))
        finding = F.when(F.col("b.hash").isNull(), "missing").when(F.col("a.hash").isNull(), "extra").otherwise("changed")
        found = stash(differ.select("file", "n", F.coalesce("a.begin", "b.begin").alias("begin"), F.coalesce("a.end", "b.end").alias("end"), finding.alias("finding")))
        suspects = found.select("file", F.col("n").alias("up"))
    return found


def op10_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of the archive of all pages in which Spark has damaged every 97th page (by id) and lost every 211th."""
    damaged = lambda record: F.sha2(F.when(F.col("page_id") % 97 == 13, F.concat(record, F.lit("\x00"))).otherwise(record), 256)
    both = stash(manifest(spark.read.parquet(f"{sf_dir}/pages.parquet"), replica=damaged))
    replica = both.filter(F.coalesce(F.col("id") % 211 != 5, F.lit(True))).select("file", "n", "begin", "end", F.col("replica").alias("hash"))
    found = audit(both, replica)
    return found.join(both.select("file", "n", "id").hint("merge"), ["file", "n"]).select(F.col("id").alias("page_id"), "finding", (F.col("end") - F.col("begin")).alias("n_bytes"))


OP10_SQL = """
with p as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages
  where page_id % 97 = 13 or page_id % 211 = 5
)
select page_id, case when page_id % 211 = 5 then 'missing' else 'changed' end as finding,
  cast(length('WARC/1.0') + 2 + length('WARC-Type: resource') + 2 + length('WARC-Record-ID: <urn:sha256:>') + 64 + 2
    + length('WARC-Target-URI: ') + strlen(url) + 2 + length('Content-Type: text/html') + 2
    + length('Content-Length: ') + length(cast(strlen(html) as varchar)) + 4 + strlen(html) + 4 as bigint) as n_bytes
from p
"""
