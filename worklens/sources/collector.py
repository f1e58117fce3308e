"""Collectors as Spark data sources: `spark.read.format("transcripts").load(root)` gives the lines of a surface's session files."""

from __future__ import annotations

from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import lines_of, located
from .transcripts import LINES


class SessionFile(InputPartition):
    def __init__(self, path: str, mtime: datetime):
        super().__init__(path)
        self.path, self.mtime = path, mtime


class LinesReader(DataSourceReader):
    """A partition for each file that the collector finds; each is read where its task runs."""

    def __init__(self, collector: TranscriptSource):
        self.collector = collector

    def partitions(self) -> list[InputPartition]:
        return [SessionFile(p, t) for p, t in self.collector.discover()]

    def read(self, partition: SessionFile):
        no = 0
        for part in lines_of(partition.path):
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array([partition.mtime] * n, pa.timestamp("us", "UTC")), pa.array(range(no, no + n), pa.int32()), pa.array(part, pa.string())], names=["path", "mtime", "line_no", "raw"])
            no += n


class TranscriptSource(DataSource):
    """path, mtime, line_no, raw of `root/*/*.jsonl`, sorted by path: exactly one folder deep, so nested files don't count, nor do empty ones. A collector for another surface is a subclass with a
    name and a discover() of its own."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return LINES

    def discover(self) -> list[tuple[str, datetime]]:
        """Paths and times of the session files."""
        root = self.options["path"].rstrip("/")
        store, at = located(root)
        folders = [f for f in store.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.Directory]
        files = [f for d in folders for f in store.get_file_info(pafs.FileSelector(d.path)) if f.type == pafs.FileType.File and f.size and f.path.endswith(".jsonl")]
        start = root[: len(root) - len(at)] if root.endswith(at) else ""
        hidden = lambda p: any(x.startswith((".", "_")) for x in p.split("/")[-2:])
        return sorted((start + f.path, f.mtime or datetime.fromtimestamp(0, UTC)) for f in files if not hidden(f.path))

    def reader(self, schema) -> LinesReader:
        return LinesReader(self)


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Make collectors known to the session (without any: the one for transcripts)."""
    for s in sources or (TranscriptSource,):
        spark.dataSource.register(s)
