"""The corpus pipeline: identify the language, drop near duplicates, drop leaks, mask secrets, pack.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each result to the shared folder as Parquet
and reads it as the next stage's ``docs``. All stages but the last return the columns of ``documents`` (and any others).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia import configure
from marginalia.llm import op1_secrets, op2_language, op4_decontaminate, op5_near_dedup, op9_packing
from marginalia.llm.queries import vocabulary_file
from marginalia.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined; texts without a letter, null texts and undecided ones go."""
    configure(spark)
    return op2_language.keep_identified(docs, op2_language.fit(op2_language.learnable(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    configure(spark)
    return op5_near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no passage of ``benchmark``."""
    configure(spark)
    return op4_decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document goes."""
    configure(spark)
    return op1_secrets.masked(docs, op1_secrets.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2,048 tokens: one row per piece."""
    configure(spark)
    return op9_packing.pack(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# Models, signatures and token ids cannot be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
