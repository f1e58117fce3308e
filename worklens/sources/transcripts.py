"""JSON-lines transcripts: discovery, lines, file facts, embedded summaries, and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import parse_time

LINES = "path string, mtime timestamp, line_no int, raw string"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime of `root/*/*.jsonl`: exactly one folder deep, so nested files don't count. Spark lists no empty files. Folders are listed, as a pattern of files would make each file a
    path of its own to be looked up."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    depth = str(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()).rstrip("/").count("/") + 2
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/*")
    return files.filter(F.size(F.split("path", "/")) == depth + 1).select("path", F.col("modificationTime").alias("mtime")).orderBy("path")


def changed(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Paths whose time differs from the ledger's (path, mtime), or that it lacks."""
    return found.join(ledger.select("path", "mtime").hint("merge"), ["path", "mtime"], "left_anti")


def next_ledger(found: DataFrame, ledger: DataFrame, done: DataFrame) -> DataFrame:
    """What to remember: unchanged files and those done now (path). Failed files stay out, so they are tried again; vanished ones go."""
    same = found.join(ledger.select("path", "mtime").hint("merge"), ["path", "mtime"], "left_semi")
    return same.unionByName(found.join(done.select("path").hint("merge"), "path", "left_semi")).distinct()


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, mtime, line_no, raw: every line with its number; lines end at line feeds alone."""
    whole = spark.read.text(paths, wholetext=True)
    whole = whole.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    return whole.select("path", "mtime", F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))


def objects(lines: DataFrame) -> DataFrame:
    """`lines` that hold a JSON object, with it as `v` (variant)."""
    v = F.try_parse_json("raw")
    return lines.filter(F.trim("raw") != "").withColumn("v", v).filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor an object."""
    v = F.try_parse_json("raw")
    return lines.filter(F.trim("raw") != "").withColumn("_v", v).filter(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT")).drop("_v")


def _text(path: str, v: str = "v") -> Column:
    """A string at a path; null for other kinds."""
    got = F.try_variant_get(F.col(v), path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", got.try_cast("string"))


def _int(path: str) -> Column:
    got = F.try_variant_get(F.col("v"), path, "variant")
    return F.when(F.schema_of_variant(got) == "BIGINT", got.try_cast("bigint"))


def project_of(cwd: Column) -> Column:
    """The last part of a working folder; `unknown` without one."""
    return F.coalesce(F.nullif(F.element_at(F.split(F.rtrim(cwd, F.lit("/")), "/"), -1), F.lit("")), F.lit("unknown"))


def file_facts(objs: DataFrame) -> DataFrame:
    """path, stem, mtime, cwd, branch, project: the first working folder and branch on any line."""
    cwd, branch = _text("$.cwd"), _text("$.gitBranch")
    rows = objs.withColumns({"cwd": cwd, "branch": branch}).groupBy("path").agg(
        F.max("mtime").alias("mtime"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"), F.min_by("branch", F.when(F.col("branch").isNotNull(), F.col("line_no"))).alias("branch")
    )
    return rows.select("path", stem(F.col("path")).alias("stem"), "mtime", "cwd", "branch", project_of(F.col("cwd")).alias("project"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def summaries(lines: DataFrame) -> DataFrame:
    """path, summary, trigger, pre_tokens: the newest embedded summary that isn't empty, and the newest boundary's facts. Files without a summary have no row."""
    some = objects(lines.filter(F.col("raw").contains('"isCompactSummary"') | F.col("raw").contains('"compact_boundary"')))
    content = F.try_variant_get(F.col("v"), "$.message.content", "variant")
    parts = F.transform(F.filter(content.try_cast("array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string"))
    text = F.when(F.schema_of_variant(content) == "STRING", content.try_cast("string")).otherwise(F.array_join(parts, "\n"))
    is_summary = F.coalesce(F.try_variant_get(F.col("v"), "$.isCompactSummary", "boolean"), F.lit(False))
    rows = some.withColumns({"_s": F.when(is_summary & (F.trim(text) != ""), text), "_b": _text("$.subtype") == "compact_boundary", "_t": _text("$.compactMetadata.trigger"), "_p": _int("$.compactMetadata.preTokens")})
    out = rows.groupBy("path").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("line_no"))).alias("summary"), F.max_by(F.struct("_t", "_p"), F.when(F.col("_b"), F.col("line_no"))).alias("b"))
    return out.filter("summary is not null").select("path", "summary", F.col("b._t").alias("trigger"), F.col("b._p").alias("pre_tokens"))


def result_text(v: Column) -> Column:
    """A tool result's content as text: strings as they are, a list's texts (or the JSON of other items) joined by line feeds, else JSON."""
    item = lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.when(F.schema_of_variant(b) == "STRING", b.try_cast("string")), F.to_json(b))
    joined = F.array_join(F.transform(v.try_cast("array<variant>"), item), "\n")
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", v.try_cast("string")).when(kind.startswith("ARRAY"), joined).when(kind != "VOID", F.to_json(v))


def flatten(objs: DataFrame) -> DataFrame:
    """Turns of all files: path, id, seq, line_no, block, timestamp, role, content, tool_name, tool_input, tool_output, tool_use_id, model,
    token counts, error, source_event_id, source_parent_id.

    User text becomes a user turn (a blank string doesn't, a blank block does), tool results become tool turns, assistant texts that
    aren't blank and tool calls become assistant turns. A line's token usage goes to its first turn, or to a turn of its own.
    """
    plain = ~F.coalesce(F.try_variant_get(F.col("v"), "$.isCompactSummary", "boolean"), F.lit(False)) & (F.coalesce(_text("$.subtype"), F.lit("")) != "compact_boundary")
    lines = objs.filter(plain).withColumn("type", _text("$.type")).filter(F.col("type").isin("user", "assistant"))
    content = F.try_variant_get(F.col("v"), "$.message.content", "variant")
    usage = {"tokens_in": "input_tokens", "tokens_out": "output_tokens", "cache_creation_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens"}
    lines = lines.withColumns({"c": content, "at": parse_time(_text("$.timestamp")), "model": _text("$.message.model"), "source_event_id": _text("$.uuid"), "source_parent_id": _text("$.parentUuid")} | {k: _int(f"$.message.usage.{u}") for k, u in usage.items()})
    facts = ["path", "line_no", "type", "at", "model", "source_event_id", "source_parent_id", *usage]
    is_text = F.schema_of_variant("c") == "STRING"
    whole = lines.filter(is_text).select(*facts, F.lit(0).alias("block"), F.lit("whole").alias("kind"), F.col("c").try_cast("string").alias("text"), F.lit(None).cast("variant").alias("b"))
    blocks = lines.filter(~is_text).select(*facts, F.posexplode(F.col("c").try_cast("array<variant>")).alias("block", "b"))
    blocks = blocks.select(*facts, "block", F.try_variant_get("b", "$.type", "string").alias("kind"), F.try_variant_get("b", "$.text", "string").alias("text"), "b")
    every = whole.unionByName(blocks)
    user, visible = F.col("type") == "user", F.trim(F.coalesce("text", F.lit(""))) != ""
    is_call = ~user & (F.col("kind") == "tool_use")
    is_result = user & (F.col("kind") == "tool_result")
    keep = (user & (F.col("kind") == "whole") & visible) | (user & (F.col("kind") == "text") & F.col("text").isNotNull()) | is_result | (~user & F.col("kind").isin("whole", "text") & visible) | is_call
    get = lambda name: F.try_variant_get("b", f"$.{name}", "string")
    inp = F.try_variant_get("b", "$.input", "variant")
    out = result_text(F.try_variant_get("b", "$.content", "variant"))
    failed = F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False))
    rows = every.filter(keep).select(
        *facts, "block", F.when(is_result, "tool").otherwise(F.col("type")).alias("role"), F.when(~is_call & ~is_result, F.col("text")).alias("content"),
        F.when(is_call, get("name")).alias("call_name"), F.when(is_call, F.when(F.schema_of_variant(inp).startswith("OBJECT"), F.to_json(inp))).alias("tool_input"),
        F.when(is_result, out).alias("tool_output"), F.when(is_call, get("id")).when(is_result, get("tool_use_id")).alias("tool_use_id"), F.when(is_result & failed, F.coalesce(out, F.lit("error"))).alias("error"),
    )
    # usage without a turn gets a carrier turn
    used = F.coalesce(*usage).isNotNull()
    carrier = lines.filter((F.col("type") == "assistant") & used).join(rows.select("path", "line_no").distinct().hint("merge"), ["path", "line_no"], "left_anti")
    nothing = {c: F.lit(None).cast("string").alias(c) for c in ("content", "call_name", "tool_input", "tool_output", "tool_use_id", "error")}
    rows = rows.unionByName(carrier.select(*facts, F.lit(0).alias("block"), F.lit("assistant").alias("role"), *nothing.values()))
    first = F.row_number().over(Window.partitionBy("path", "line_no").orderBy("block")) == 1
    rows = rows.withColumn("_first", first & (F.col("type") == "assistant"))
    earlier = Window.partitionBy("path", "tool_use_id").orderBy("line_no", "block").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("call_name").isNotNull(), F.col("call_name")).when(F.col("role") == "tool", F.when(F.col("tool_use_id").isNotNull(), F.last("call_name", ignorenulls=True).over(earlier)))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("line_no", "block")) - 1
    rows = rows.withColumn("tool_name", named).withColumn("seq", seq.cast("long"))
    return rows.select(
        "path", F.format_string("%s-%06d", stem(F.col("path")), "seq").alias("id"), "seq", "line_no", "block", F.col("at").alias("timestamp"), "role", "content", "tool_name", "tool_input", "tool_output",
        "tool_use_id", "model", *[F.when(F.col("_first"), F.col(k)).alias(k) for k in usage], "error", "source_event_id", "source_parent_id",
    )
