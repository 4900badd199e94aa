"""From raw documents to packed training sequences: five stages, each one operator of ``stancelake.llm``.

Every stage works on all that the one before kept.  ``run`` writes each stage's
result as Parquet to the shared folder and hands the next one what it reads
back, so a lost executor costs a re-read and a failed stage is run again alone.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm.common import small_batches, staged
from stancelake.llm.kneser_ney import accepted_documents
from stancelake.llm.langid import in_learned_language
from stancelake.llm.mixing import mixed_documents
from stancelake.llm.neardup_sets import one_of_each
from stancelake.llm.packing import pack_documents
from stancelake.llm.q_packing import tokenizer_files
from stancelake.llm.q_quality import TRUSTED

LEAST_SCORE = 0.5               # posterior of the language below which a text has none


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts; null and empty texts go."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted_documents(docs, labels, TRUSTED)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a score of LEAST_SCORE or more and fits its n-grams; if no document has a language, all."""
    small_batches(spark)
    if docs.filter("lang is not null and text is not null").isEmpty():
        return docs
    return in_learned_language(docs, F.col("lang").isNotNull(), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates (5-word shingles, Jaccard 0.75)."""
    small_batches(spark)
    return one_of_each(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops and repeats documents so that sources meet their targets; at most three times each."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    small_batches(spark)
    return pack_documents(docs, **tokenizer_files(), capacity=1024)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

# Perplexity, naive Bayes and tokenizers have no SQL form: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
