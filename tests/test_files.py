"""Collectors, capture with failing files, and tables changed in place."""

import json
import os
import random
import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from worklens.operators import keyed
from worklens.plans.capture import capture
from worklens.sources import collector, files, tables, transcripts


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines))


def say(text, minute=0):
    return json.dumps({"type": "user", "timestamp": f"2026-06-14T11:{minute:02d}:00Z", "cwd": "/w/demo", "message": {"content": text}})


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "root"
    write(r / "p1" / "a.jsonl", say("one"), "", "  ", b'{"bad": "\xff\xfe"}', "{broken", say("two still two", 1))
    write(r / "p1" / "b.jsonl", say("three"))
    write(r / "p2" / "c.jsonl", say("four"), "")
    write(r / "p2" / "empty.jsonl")
    write(r / "p2" / "nested" / "d.jsonl", say("five"))
    write(r / "top.jsonl", say("six"))
    write(r / "p2" / "notes.txt", "x")
    return r


def test_discovery(spark, root):
    got = [r.path.rsplit("/", 2)[-2:] for r in transcripts.discover(spark, str(root)).collect()]
    assert got == [["p1", "a.jsonl"], ["p1", "b.jsonl"], ["p2", "c.jsonl"]]


def test_collector_reads_what_spark_reads(spark, root):
    collector.register(spark)
    df = spark.read.format("transcripts").load(str(root))
    assert df.schema.simpleString() == "struct<path:string,mtime:timestamp,line_no:int,raw:string>" and df.rdd.getNumPartitions() == 3
    plain = lambda rows: sorted((re.sub("^file:/*", "/", r.path), r.mtime.replace(microsecond=0), r.line_no, r.raw) for r in rows)
    want = plain(transcripts.read_lines(spark, f"{root}/*/*.jsonl").collect())
    assert plain(df.collect()) == want and len(want) == 9 and any("�" in w[3] for w in want) and {w[2] for w in want} == set(range(6))
    assert plain(spark.read.format("transcripts").load(f"file://{root}").collect()) == want
    assert df.filter("raw like '%three%'").count() == 1


def test_own_collector(spark, root):
    class Notes(collector.TranscriptSource):
        @classmethod
        def name(cls):
            return "notes"

        def discover(self):
            return [(f"{self.options['path']}/p2/notes.txt", datetime(2026, 1, 1, tzinfo=UTC))]

    collector.register(spark, Notes)
    assert [(r.line_no, r.raw) for r in spark.read.format("notes").load(str(root)).collect()] == [(0, "x")]


def test_lines_over_blocks(tmp_path):
    rng = random.Random(1)
    text = "\n".join("é" * rng.randint(0, 3000) for _ in range(3000))
    (tmp_path / "x").write_text(text)
    parts = list(files.lines_of(str(tmp_path / "x")))
    assert [line for p in parts for line in p] == text.split("\n") and len(parts) > 1


def test_one_unreadable_file_fails_alone(spark, root):
    """A link to itself can't be opened, whoever runs the test."""
    bad = root / "p1" / "b.jsonl"
    kept = bad.read_bytes()
    found = spark.createDataFrame(transcripts.discover(spark, str(root)).collect())
    bad.unlink()
    os.symlink("b.jsonl", bad)
    lines, failed = files.read_lines_of(found)
    assert [os.path.basename(r.path) for r in failed.collect()] == ["b.jsonl"]
    assert {os.path.basename(r.path) for r in lines.select("path").distinct().collect()} == {"a.jsonl", "c.jsonl"}
    bad.unlink()
    bad.write_bytes(kept)


def test_capture_cycles(spark, root, monkeypatch):
    import worklens.plans.capture as plan

    nothing = spark.createDataFrame([], "path string, mtime timestamp")
    broken = {"b.jsonl"}
    good = files.read_lines_of

    def some(paths):  # files that fail, as a store would fail
        lines, failed = good(paths)
        hit = F.element_at(F.split("path", "/"), -1).isin(*broken) if broken else F.lit(False)
        extra = paths.filter(hit).select("path", "mtime", F.lit("OSError: no").alias("error"))
        return lines.filter(~hit), failed.union(extra)

    monkeypatch.setattr(plan, "read_lines_of", some)
    name = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    sessions, turns, ledger, failures = capture(spark, str(root), nothing, actor="me")
    assert name(ledger) == ["a.jsonl", "c.jsonl"] and [(os.path.basename(r.path), r.tries) for r in failures.collect()] == [("b.jsonl", 1)]
    assert {r.base_session_id for r in sessions.collect()} == {"a", "c"} and turns.count() == 3
    again = capture(spark, str(root), ledger, (sessions, turns), failures, actor="me")
    assert [(os.path.basename(r.path), r.tries) for r in again[3].collect()] == [("b.jsonl", 2)] and again[0].count() == 2
    broken.clear()
    third = capture(spark, str(root), again[2], (again[0], again[1]), again[3], actor="me")
    assert third[3].count() == 0 and name(third[2]) == ["a.jsonl", "b.jsonl", "c.jsonl"] and {r.base_session_id for r in third[0].collect()} == {"a", "b", "c"}
    write(root / "p2" / "c.jsonl", say("four"), say("more", 50))
    os.utime(root / "p2" / "c.jsonl", (1, 1))
    (root / "p1" / "a.jsonl").unlink()
    fourth = capture(spark, str(root), third[2], (third[0], third[1]), third[3], actor="me")
    assert name(fourth[2]) == ["b.jsonl", "c.jsonl"]
    assert sorted(r.id for r in fourth[0].collect()) == ["a", "b", "c", "c.2"]


def test_versions(spark, tmp_path):
    shape = "a int, b string"
    assert tables.read_table(spark, str(tmp_path), "t", shape).count() == 0
    for k in range(3):
        tables.replace_table(spark.createDataFrame([(k, "x")], shape), str(tmp_path), "t", partition_by=("b",))
        assert [tuple(r) for r in tables.read_table(spark, str(tmp_path), "t", shape).collect()] == [(k, "x")]
    os.makedirs(tmp_path / "t" / "_current-v-9" / "_temporary")  # a pointer that is being written
    assert tables.read_table(spark, str(tmp_path), "t", shape).first().a == 2


def held(path):
    return {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_families_in_place(spark, tmp_path):
    shape = "id string, base string, v int"
    rows = [(f"f{k}.{i}", f"f{k}", i) for k in range(40) for i in range(k % 4 + 1)] + [("n.1", None, 5)]
    t = tables.KeyedTable(spark, str(tmp_path / "t"), shape, "base", buckets=16)
    assert t.read().count() == 0
    t.replace(spark.createDataFrame([], "base string"), spark.createDataFrame(rows, shape))
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(rows, key=str)
    before = held(tmp_path / "t")
    new = [("f3.9", "f3", 9), ("f7.9", "f7", 9)]
    families = spark.createDataFrame([("f3",), ("f7",), ("f11",)], "base string")  # f11 goes
    t.replace(families, spark.createDataFrame(new, shape))
    want = [r for r in rows if r[1] not in ("f3", "f7", "f11")] + new
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(want, key=str)
    full = spark.createDataFrame(rows, shape).join(families, "base", "left_anti").select("id", "base", "v").union(spark.createDataFrame(new, shape))
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(map(tuple, full.collect()), key=str)
    after = held(tmp_path / "t")
    touched = {x.split("/")[0] for x in before - after}
    assert 1 <= len(touched) <= 3 and {x for x in before if x.split("/")[0] not in touched} <= after


def test_upserts_in_place(spark, tmp_path):
    shape = "id string, v int"
    t = tables.KeyedTable(spark, str(tmp_path / "t"), shape, "id", buckets=8)
    rows = [(f"k{i}", i) for i in range(50)]
    t.upsert(spark.createDataFrame(rows, shape), ["id"])
    before = held(tmp_path / "t")
    new = spark.createDataFrame([("k3", 300), ("k99", 99)], shape)
    want = keyed.upsert(spark.createDataFrame(rows, shape), new, ["id"])
    for _ in range(2):  # the same again changes nothing
        t.upsert(new, ["id"])
        assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, want.select("id", "v").collect()))
    assert len(before & held(tmp_path / "t")) >= 6
    t.upsert(new.filter("false"), ["id"])
    t.replace(spark.createDataFrame([(f"k{i}",) for i in range(100)], "id string"), new.filter("false"))
    assert t.read().count() == 0


def test_raw_export_as_files(spark, tmp_path):
    from worklens.operators import release

    lines = spark.createDataFrame([("o", "t", "c1", 1, '{"b": 2}'), ("o", "t", "c1", 0, '{"a": "é"}'), ("o", "u", "c2", 0, "{}")], "org_id string, team_id string, compaction_id string, seq long, value string")
    root = str(tmp_path / "raw")
    for _ in range(2):  # the same again puts the same files in the same places
        got = {r.compaction_id: (r.id, r.org_id, r.team_id, r.path) for r in release.export_raw(lines, root).collect()}
        assert got == {"c1": ("raw::o::c1", "o", "t", f"{root}/o/t/c1.jsonl"), "c2": ("raw::o::c2", "o", "u", f"{root}/o/u/c2.jsonl")}
        assert (tmp_path / "raw" / "o" / "t" / "c1.jsonl").read_text() == '{"a": "é"}\n{"b": 2}\n'
    assert sorted(f for _, _, names in os.walk(root) for f in names) == ["c1.jsonl", "c2.jsonl"]
    back = transcripts.read_lines(spark, f"{root}/*/*/*.jsonl").filter("raw <> ''")
    assert back.count() == 3


def test_discovery_lists_folders_and_no_single_files(spark, tmp_path):
    for name in ("a/1.jsonl", "a/2.jsonl", "b c/3.jsonl", "a/deep/4.jsonl", "a/5.txt", "6.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = transcripts.discover(spark, root)
        assert ["/".join(r.path.split("/")[-2:]) for r in found.collect()] == ["a/1.jsonl", "a/2.jsonl", "b c/3.jsonl"]
        roots = found._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths()
        assert roots.size() == 3  # two folders, and a file that lies beside them
