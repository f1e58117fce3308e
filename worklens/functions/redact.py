"""Secrets and personal data in text: replace, detect, and flag what needs approval."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..plans.state import settle
from ..schemas import any_of

# fixed values: what is matched; (?i) ignores case
SECRETS = [
    ("aws_key", r"(?i)(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("generic_secret", r"""(?i)(?:secret|password|token|api[_-]?key)\s*[:=]\s*["'][^"']{8,}"""),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
]
APPROVAL = [r"git\s+push\s+.*--force", r"git\s+reset\s+--hard", r"rm\s+-rf?\s", r"(?i)DROP\s+(?:TABLE|DATABASE)", r"(?i)DELETE\s+FROM\s+\w+\s*(?:;|$)"]
SENSITIVE = [r"\.env(?:\.|$)", r"(?i)credentials", r"(?i)secrets?\.", r"\.pem$", r"\.key$", r"id_rsa"]
KEPT = ("id", "session_id", "actor", "surface", "project", "kind", "tier_used", "outcome", "prompt_version", "action_triggers", "source")


def patterns(*, secrets=True, personal=True, extra: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """The active (name, pattern) pairs, in the order in which they are applied."""
    return [*(SECRETS if secrets else []), *(PERSONAL if personal else []), *(extra or [])]


def redact(text: Column, active: list[tuple[str, str]] | None = None) -> Column:
    """Every match replaced by [REDACTED:name]; null and empty stay."""
    for name, pattern in patterns() if active is None else active:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{name}]")
    return text


def detect(text: Column, active: list[tuple[str, str]] | None = None) -> Column:
    """Names of the patterns that match."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in (patterns() if active is None else active)]))


def approval_required(command: Column) -> Column:
    """The patterns of commands that need approval and match."""
    return F.array_compact(F.array(*[F.when(command.rlike(p), F.lit(p.removeprefix("(?i)"))) for p in APPROVAL]))


def sensitive_path(path: Column) -> Column:
    return any_of([path.rlike(p) for p in SENSITIVE])


def redact_value(value, active: list[tuple[str, re.Pattern]]):
    """Strings and keys at any depth of a decoded JSON value."""
    if isinstance(value, str):
        for name, p in active:
            value = p.sub(f"[REDACTED:{name}]", value)
        return value
    if isinstance(value, list):
        return [redact_value(v, active) for v in value]
    if isinstance(value, dict):
        return {redact_value(k, active): redact_value(v, active) for k, v in value.items()}
    return value


def redact_json(column: Column, active: list[tuple[str, str]] | None = None) -> Column:
    """JSON text with every string and key redacted; text that isn't JSON is redacted as text. One column expression, row by row in Python; redact_nested() works
    on a whole table without it."""
    named = patterns() if active is None else active

    @F.pandas_udf(StringType())
    def run(texts):
        compiled = [(n, re.compile(p, re.ASCII)) for n, p in named]

        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(redact_value(json.loads(text), compiled), ensure_ascii=False)
            except ValueError:
                return redact_value(text, compiled)

        return texts.map(one, na_action="ignore")

    return run(column)


ANCHORED = re.compile(r"[\^$]|\\[bBAZz]|\(\?[=!<]")


def _quoted(text: Column) -> Column:
    """A string as JSON text."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


QUOTED_BACKSLASH, QUOTED_QUOTE = "\x01", "\x02"  # JSON holds neither as it is


def _by_literals(text: Column, named: list[tuple[str, str]]) -> Column:
    """JSON text with the strings and keys between its quotes redacted; what is between them otherwise stays."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(QUOTED_BACKSLASH)), F.lit('\\"'), F.lit(QUOTED_QUOTE))
    plain = all(re.fullmatch(r"[\w .:-]*", n) for n, _ in named)

    def literal(x):
        hard = x.rlike(rf"[\\{QUOTED_BACKSLASH}{QUOTED_QUOTE}]") if plain else F.lit(True)
        spelt = F.replace(F.replace(x, F.lit(QUOTED_BACKSLASH), F.lit("\\\\")), F.lit(QUOTED_QUOTE), F.lit('\\"'))
        said = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), spelt, F.lit('"'))), "$", "string")
        # without a string, a lone quote makes the whole no JSON
        return F.coalesce(F.when(hard, _quoted(redact(said, named))).otherwise(F.concat(F.lit('"'), redact(x, named), F.lit('"'))), F.lit('"'))

    return F.array_join(F.transform(F.split(marked, '"', -1), lambda x, i: F.when(i % 2 == 1, literal(x)).otherwise(x)), "")


def redact_nested(rows: DataFrame, column: str, active: list[tuple[str, str]] | None = None) -> DataFrame:
    """`rows` with every string and key of the JSON text in `column` redacted at any depth, without Python and row by row, literal by literal (_by_literals). Only documents in which
    keys become equal are opened level by level (variant_explode) into values with their paths; values and keys are redacted as text, and containers are put together again from the
    deepest level up.

    As redact_json(), except that keys come out in order, that of keys which become equal the last in order stays, and that a document in which no pattern can match keeps its
    spelling. Text that isn't JSON (or names a key twice) is redacted as text. Levels are written to the shared folder, as many as the deepest of those documents has.
    """
    named = patterns() if active is None else active
    spark, text = rows.sparkSession, F.col(f"`{column}`")
    # without escapes a string stands in the text as it is, so where a pattern without anchors finds nothing it finds nothing in any part
    free = F.lit(False) if any(ANCHORED.search(p) for _, p in named) else ~text.contains("\\") & (F.size(detect(text, named)) == 0)
    staged = rows.withColumns({"wl_row": F.monotonically_increasing_id(), "wl_free": F.coalesce(free, F.lit(True))})
    staged = staged.withColumn("wl_json", ~F.col("wl_free") & F.try_parse_json(text).isNotNull())
    # a text that names a key twice is no JSON, so a document whose keys become equal has no quick form
    staged = staged.withColumn("wl_quick", F.when(F.col("wl_json") & ~text.rlike(f"[{QUOTED_BACKSLASH}{QUOTED_QUOTE}]"), F.to_json(F.try_parse_json(_by_literals(text, named)))))
    new = F.when(F.col("wl_free"), text).when(~F.col("wl_json"), redact(text, named)).otherwise(F.col("wl_quick"))
    base = settle(staged.withColumns({"wl_new": new, "wl_slow": F.col("wl_json") & F.col("wl_quick").isNull()}).drop("wl_free", "wl_json", "wl_quick"))
    columns = [f"`{c}`" for c in rows.columns]
    done, slow = base.filter("not wl_slow").withColumn(column, F.col("wl_new")).select(*columns), base.filter("wl_slow")
    if slow.isEmpty():
        return done
    level = slow.select("wl_row", F.array().cast("array<struct<pos:int,key:string>>").alias("path"), F.try_parse_json(text).alias("v"))
    kind, levels = F.schema_of_variant("v"), []
    while True:
        level = settle(level)
        holds = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~F.to_json("v").isin("{}", "[]")
        value = F.when(kind == "STRING", _quoted(redact(F.try_variant_get("v", "$", "string"), named))).otherwise(F.to_json("v"))
        levels.append(level.filter(~holds).select("wl_row", "path", value.alias("text")))
        inner = level.filter(holds)
        if inner.isEmpty():
            break
        opened = spark.sql("select t.wl_row, t.path, e.pos, e.key, e.value as v from {t} t, lateral variant_explode(t.v) e", t=inner)
        level = opened.select("wl_row", F.concat("path", F.array(F.struct("pos", "key"))).alias("path"), "v")
    built = levels.pop()
    while levels:
        own, last = F.slice("path", F.lit(1), F.size("path") - 1), F.element_at("path", -1)
        part = built.select("wl_row", own.alias("path"), last["pos"].alias("pos"), F.when(last["key"].isNotNull(), _quoted(redact(last["key"], named))).alias("key"), last["key"].isNotNull().alias("named"), "text")
        # an array's places are its keys
        once = part.groupBy("wl_row", "path", "named", F.coalesce("key", F.col("pos").cast("string")).alias("key")).agg(F.max(F.struct("pos", "text")).alias("x"))
        item = F.when(F.col("named"), F.concat("key", F.lit(":"), F.col("x.text"))).otherwise(F.col("x.text"))
        whole = once.groupBy("wl_row", "path", "named").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.pos").alias("pos"), item.alias("item")))), lambda y: y["item"]), ",").alias("items"))
        braced = F.when(F.col("named"), F.concat(F.lit("{"), "items", F.lit("}"))).otherwise(F.concat(F.lit("["), "items", F.lit("]")))
        built = levels.pop().unionByName(whole.select("wl_row", "path", braced.alias("text")))
    opened = slow.join(built.select("wl_row", F.col("text").alias("wl_text")).hint("merge"), "wl_row", "left").withColumn(column, F.coalesce("wl_text", redact(text, named)))
    return done.unionByName(opened.select(*columns))


def redact_turns(turns: DataFrame, active=None) -> DataFrame:
    """Content, tool output and error as text, tool input as JSON."""
    for c in ("content", "tool_output", "error"):
        if c in turns.columns:
            turns = turns.withColumn(c, redact(F.col(c), active))
    if "tool_input" in turns.columns:
        turns = turns.withColumn("tool_input", redact_json(F.col("tool_input"), active))
    return turns


def redact_compactions(rows: DataFrame, active=None, keep: tuple[str, ...] = KEPT) -> DataFrame:
    """Every string and list of strings but the kept ones, whatever other columns there are; friction descriptions too, their references not."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "friction_points":
            c = F.transform(c, lambda p: p.withField("description", redact(p["description"], active)))
        elif f.name not in keep and isinstance(f.dataType, StringType):
            c = redact(c, active)
        elif f.name not in keep and isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            c = F.transform(c, lambda x: redact(x, active))
        out.append(c.alias(f.name))
    return rows.select(*out)
