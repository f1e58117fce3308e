"""Language identification by known words first, then ever shorter character n-grams.

Training takes a bounded sample of labelled texts (`per_lang` of each language, by hash of the id; at
most `max_chars` characters a text) and counts its words and n-grams with Spark. A word that
the sample holds at least twice is *known* and scores its log frequency in each language. Any
other word is walked left to right; at each place the longest known n-gram (`max_n` down to 1) that
starts there gives its log frequency, and the word scores the mean of these. A text's
language is the one with the largest sum over all its words.

Cases: null text or one without a letter gives `und` with score 0; so does every text if no label was
learned. Letters are Unicode letters, not numerals or fractions. Every label that occurs is learned, `und` too (the
pipeline's stage drops what is predicted so), and the model grows with their number. Equal sums go to the alphabetically first language. Rows with a null id are scored; they count as held
out only if their remainder says so (null: not held out). Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import remainder, resident, slices

# letters alone: \w also takes superscripts, fractions and numerals that look like letters
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(rf"[^\W\d_{_NUMERALS}]+")
NEARLY = re.compile(r"[^\W\d_]+")
MEMO = 400_000


def words_of(text: str) -> list[str]:
    """As WORD.findall(); its many exceptions are slow and rare, so it runs only on texts that hold one."""
    found = NEARLY.findall(text)
    return found if "".join(found).isalpha() else WORD.findall(text)


def train(docs: DataFrame, *, text_col="text", lang_col="lang", id_col="doc_id", per_lang=600, max_chars=20_000, max_n=5, top=20_000) -> dict:
    """Word and n-gram log frequencies by language, from a bounded sample of labelled texts (at most `top` of each kind for a language)."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("g"))
    rows = rows.filter("t is not null and g is not null").filter(F.length("t") <= max_chars)
    counts = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {"langs": [], "index": {}, "table": np.zeros((0, 0), np.float32), "max_n": max_n}
    langs = sorted(counts)
    # a hash of the id picks about per_lang rows of each language
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, per_lang / counts[g])))])
    picked = rows.filter(F.col("g").isin(langs)).filter((F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1_000_003)) / 1_000_003) < share[F.col("g")])
    words = picked.select("g", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).groupBy("g", "w").agg(F.count("*").alias("n"))
    words = words.repartition(F.col("w")).persist()
    marked = F.concat(F.lit("<"), F.col("w"), F.lit(">"))
    grams = words.select("g", "n", marked.alias("m")).select(
        "g", "n", F.explode(F.flatten(F.array(*[F.expr(f"transform(sequence(1, greatest(1, length(m) - {k - 1})), p -> substring(m, p, {k}))") for k in range(1, max_n + 1)]))).alias("w")
    )
    grams = grams.groupBy("g", "w").agg(F.sum("n").alias("n")).withColumn("k", F.length("w"))
    known = words.filter("n >= 2").withColumn("k", F.lit(0))
    both = known.unionByName(grams.filter("n >= 3"))
    best = Window.partitionBy("g", "k").orderBy(F.desc("n"), "w")
    got = both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).select("g", "w", "k", "n").toPandas()
    words.unpersist()
    table: list[np.ndarray] = []
    index: dict[tuple[bool, str], int] = {}
    at = {g: j for j, g in enumerate(langs)}
    for k, part in got.groupby("k"):
        total = np.ones(len(langs))
        for g, s in part.groupby("g")["n"].sum().items():
            total[at[g]] += s
        codes, kinds = pd.factorize(part["w"])
        n = np.zeros((len(kinds), len(langs)))
        np.add.at(n, (codes, part["g"].map(at).to_numpy()), part["n"].to_numpy())
        index.update(zip([(k == 0, w) for w in kinds], range(len(index), len(index) + len(kinds)), strict=True))
        table.append(np.log((n + 0.1) / (total + 0.1 * len(kinds))).astype(np.float32))
    return {"langs": langs, "index": index, "table": np.concatenate([np.zeros((0, len(langs)), np.float32), *table]), "max_n": max_n}


class _Rows(dict):
    """Word to row number; an unseen word's row is made from its n-grams and kept while there is room."""

    def __init__(self, model: dict):
        super().__init__({w: i for (is_word, w), i in model["index"].items() if is_word})
        self.grams = {w: i for (is_word, w), i in model["index"].items() if not is_word}
        self.n, self.model = model["max_n"], model
        self.rows = np.empty((len(model["table"]) + MEMO, len(model["langs"])), np.float32)
        self.rows[: len(model["table"])] = model["table"]
        self.used = self.first = len(model["table"])

    def __missing__(self, word: str) -> int:
        if self.used == len(self.rows):  # full: forget the unseen words only
            self.spare = None
            raise KeyError(word)
        self.rows[self.used] = self.unseen(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def unseen(self, word: str) -> np.ndarray:
        m, hits, get = f"<{word}>", [], self.grams.get
        size = len(m)
        for p in range(size):
            for k in range(min(self.n, size - p), 0, -1):
                if (i := get(m[p : p + k])) is not None:
                    hits.append(i)
                    break
        return self.model["table"][hits].mean(axis=0) if hits else np.zeros(self.rows.shape[1], np.float32)

    def sums(self, words: list[str]) -> np.ndarray:
        try:
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            return self.rows[at].sum(axis=0, dtype=np.float64)
        except KeyError:
            at = [(w, self.get(w)) for w in words]
            out = self.rows[[i for _, i in at if i is not None]].sum(axis=0, dtype=np.float64)
            for w, i in at:
                if i is None:
                    out += self.unseen(w)
            return out


def predict(docs: DataFrame, model: dict, *, text_col="text", out=("lang_pred", "lang_score")) -> DataFrame:
    """`docs` with two columns more: the language and its share of the likelihood (0 to 1). The model is bounded by train()'s parameters."""
    spark: SparkSession = docs.sparkSession
    sent, langs = spark.sparkContext.broadcast(model), model["langs"]
    key = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = resident(key, lambda: _Rows(sent.value))
        for batch in slices(batches, text_col):
            names, scores = [], []
            for text in batch.column(text_col).to_pylist():
                words = words_of(text.lower()) if text else []
                if not words or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                s = rows.sums(words)
                j = int(s.argmax())
                names.append(langs[j])
                scores.append(float(1 / np.exp(s - s[j]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *out])

    schema = StructType([*docs.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())])
    return docs.mapInArrow(score, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = remainder("doc_id", 4) == 2
    model = train(docs.filter(~held))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: texts without a letter, and those for which no language has `min_score` of the likelihood, go."""
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    found = predict(docs, model, out=("_wl_lang", "_wl_score"))
    return found.filter((F.col("_wl_lang") != "und") & (F.col("_wl_score") >= min_score)).select(*docs.columns)
