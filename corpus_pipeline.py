"""A training-corpus pipeline: rules, exact copies, near copies, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``.  The mixed order lives in the order of the mixing stage's
files and their rows; the packing stage packs stretches of it and numbers sequences by
stretch, so sequence ids follow the mixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from folio.llm.queries import tokenizer
from folio.session import keep


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that holds every source to its weight."""
    return mixing.ordered(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, numbered in mixed order."""
    return packing.pack_in_order(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_duplicates", near), ("mixing", mix), ("packing", pack)]

#: Near-duplicate components and tokenizer output are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
