"""Files read and written on executors: from a table of paths, where what can't be read stands in a table of its own, and as one file for each name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import settle
from .transcripts import LINES

RAW = f"{LINES}, error string"
ROWS = 2000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there. Spark writes local ones as file:/x."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def lines_of(path: str) -> Iterator[list[str]]:
    """A file's lines, some at a time; they end at line feeds alone, and bytes that aren't UTF-8 are replaced. An empty file has one empty line."""
    store, at = located(path)
    rest, part = b"", []
    with store.open_input_stream(at) as f:
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            part += [x.decode("utf-8", "replace") for x in whole]
            if len(part) >= ROWS:
                yield part
                part = []
    yield [*part, rest.decode("utf-8", "replace")]


def read_files(paths: DataFrame) -> DataFrame:
    """path, mtime, line_no, raw, error of the files in `paths` (path, mtime): a row for each line, or one row with an error and without a line if any of the file
    can't be read. Files are dealt over the executors and read there; the driver sees no path."""

    def read(batches):
        for batch in batches:
            for path, mtime in zip(batch.column(0), batch.column(1), strict=True):
                name, no, held = path.as_py(), 0, []
                try:
                    # a file counts whole or not at all, so its lines wait for its end
                    for part in lines_of(name):
                        held.append(pa.array(part, pa.string()))
                except (OSError, pa.ArrowException, ValueError) as e:
                    yield _rows(name, mtime, [None], [None], [f"{type(e).__name__}: {e}"[:500]])
                    continue
                for part in held:
                    yield _rows(name, mtime, range(no, no + len(part)), part, [None] * len(part))
                    no += len(part)

    return paths.select("path", "mtime").repartition(F.col("path")).mapInArrow(read, RAW)


def _rows(path, mtime, numbers, raw, errors) -> pa.RecordBatch:
    n = len(errors)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([mtime.as_py()] * n, mtime.type), pa.array(numbers, pa.int32()), pa.array(raw, pa.string()), pa.array(errors, pa.string())], names=["path", "mtime", "line_no", "raw", "error"])


def read_lines_of(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (path, mtime, line_no, raw) and failures (path, mtime, error) of the files in `paths`."""
    rows = read_files(paths)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("path", "mtime", "error")


def write_files(lines: DataFrame, root: str) -> DataFrame:
    """path, lines, bytes: a file `root/<name>` for each name in `lines` (name, no, line), its lines in order, each ended by a line feed. Written on executors to a name of its own and
    then renamed, so a task that runs again puts the same file in the same place; a name may hold folders. `root` has to be in a store that executors share."""

    def put(table: pa.Table) -> pa.Table:
        name = table.column("name")[0].as_py()
        text = "".join(f"{x}\n" for x in table.sort_by("no").column("line").to_pylist()).encode()
        store, at = located(f"{root.rstrip('/')}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        part = f"{at.rpartition('/')[0]}/_{uuid.uuid4().hex}"  # hidden from readers
        with store.open_output_stream(part) as f:
            f.write(text)
        store.move(part, at)
        return pa.table({"path": [f"{root.rstrip('/')}/{name}"], "lines": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([len(text)], pa.int64())})

    rows = lines.select("name", F.col("no").cast("long").alias("no"), F.coalesce("line", F.lit("")).alias("line"))
    return settle(rows.groupBy("name").applyInArrow(put, "path string, lines long, bytes long"))
