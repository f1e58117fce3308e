"""The corpus pipeline: documents that pass every filter, once each, without repeated passages, packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklens.llm.common import stash
from worklens.llm.langid import language_stage
from worklens.llm.packing import packing_stage
from worklens.llm.simhash import simhash_stage
from worklens.llm.suffix_dedup import suffix_stage
from worklens.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_dedup", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: None: trained models, fingerprints and tokens can't be expressed in SQL; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
    return docs
