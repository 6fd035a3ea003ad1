"""From raw documents to packed training windows, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import decontaminate, jaccard_join, language, packing, secret_scan, similar_sets
from spendlens.llm.common import table
from spendlens.session import shared_scratch

ORACLE_SQL = None  # no SQL can say the language model, the tokenizer or the packing; tests hold them against brute force


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told; undetermined and ambiguous texts go.  A missing lang is filled in."""
    told = language.identify(docs, language.fit_language(docs)).where(
        (F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous"))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id; rows without words stay.

    A row is told by its id and its text, so an id on two unrelated texts keeps both, and of copies without an id one stays.
    """
    return similar_sets.one_of_each(docs, jaccard_join.linked_documents(docs)).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark."""
    marked = decontaminate.mark_passages(docs, table(spark, sf_dir, "benchmark"))
    return marked.where("leaks = 0").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew where the text changed."""
    found = secret_scan.scan(docs, secret_scan.fit_markov(docs)).withColumn("clean", secret_scan.redact(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    cols = {"text": F.col("clean"), "n_chars": F.when(changed, F.length("clean").cast("bigint")).otherwise(F.col("n_chars"))}
    return found.select(*[cols.get(c, F.col(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a window of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("language", by_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
