"""Redaction of nested JSON without Python against the row-by-row form."""

import json
import random
import re

from pyspark.sql import functions as F

from worklens.functions import redact as R

LEAVES = ["a@b.co", "plain", "", 'quote " and \\ back', "é\n\t", "555-123-4567", "x y@z.org w", 0, -3, 12345678901234, 1.5, True, False, None, "ghp_" + "a" * 36, {}, []]


def document(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(LEAVES)
    if kind < 0.6:
        return [document(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {f"{rng.choice(['k', 'long key', 'é', 'q\"'])}{i}": document(rng, depth - 1) for i in range(rng.randint(0, 4))} | ({f"m{rng.randint(0, 9)}@x.org": document(rng, depth - 1)} if rng.random() < 0.3 else {})


def test_nested_matches_row_by_row(spark):
    rng = random.Random(3)
    texts = [json.dumps(document(rng, rng.randint(0, 6)), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(300)]
    texts += [json.dumps({"esc": "a@b.co"}).replace("@", "\\u0040"), "not json x@y.org", "", None, "[1, 2", '"only a@b.co"', texts[0], "[[[[[[[[[\"deep@x.org\"]]]]]]]]]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, j string").withColumns({"text": F.lit("t"), "path": F.lit(1), "v": F.lit(2)}).repartition(3)
    out = R.redact_nested(rows, "j")
    want = {r.id: r.j for r in rows.select("id", R.redact_json(F.col("j")).alias("j")).collect()}
    assert out.columns == rows.columns

    def value(t):
        try:
            return json.loads(t)
        except (TypeError, ValueError):
            return t

    got = {r.id: r.j for r in out.collect()}
    assert {i: value(t) for i, t in got.items()} == {i: value(t) for i, t in want.items()}
    assert not any(t and re.search(r"[a-z]@[a-z]", t) for t in got.values())
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_nested_with_anchored_patterns(spark):
    rows = spark.createDataFrame([('{"a": "secret", "b": ["no secret"], "secret": 1}',), (None,)], "j string")
    out = [r.j for r in R.redact_nested(rows, "j", [("whole", "^secret$")]).collect()]
    assert [None if t is None else json.loads(t) for t in out] == [{"a": "[REDACTED:whole]", "b": ["no secret"], "[REDACTED:whole]": 1}, None]
    assert R.redact_nested(rows.filter("false"), "j").count() == 0


def test_keys_that_become_equal(spark):
    rows = spark.createDataFrame([('{"a@b.co": 1, "c@d.co": {"e@f.co": "g@h.co"}}',)], "j string")
    assert json.loads(R.redact_nested(rows, "j").first().j) == {"[REDACTED:email]": {"[REDACTED:email]": "[REDACTED:email]"}}


def test_no_rows_travel_unless_keys_become_equal(spark):
    texts = ['{"a": "say \\"hi\\" to a@b.co", "b\\\\": ["x\\\\\\\\\\"", {"c@d.co": 1.50}], "\\u0065@f.co": "\\n"}', '{"password: ": "12345678"}', '{"a@b.co": 1, "c@d.co": 2}', "no json a@b.co", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, j string")
    value = lambda t: json.loads(t) if t and t.startswith("{") else t
    want = {r.id: value(r.j) for r in rows.select("id", R.redact_json(F.col("j")).alias("j")).collect()}
    assert {r.id: value(r.j) for r in R.redact_nested(rows, "j").collect()} == want
    plan = lambda some: R.redact_nested(some, "j")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(rows.filter("id <> 2")) and "Exchange" in plan(rows)
