"""The corpus pipeline: five stages over documents, each written as Parquet and
read again as the next one's input.

Stages keep the columns of documents; the last returns the mixture, one row for
each copy of a document. Language identification drops what has no letter or no
dominant language; line deduplication shortens texts; of each class of linked
documents the one with the smallest doc_id stays; documents that hold benchmark
items go; the rest is mixed to the target weights of its sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, langmix, line_runs, mixing, ngram_join, tiling

#: A document stays if its main language has at least this share of it.
LEAST_SHARE = 0.35
#: Shingle length and least similarity of near-duplicates.
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """8: drop documents that are ``und`` or have no dominant language."""
    return langmix.keep_identified(docs, LEAST_SHARE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """7: drop repeated lines; n_chars follows the text."""
    return line_runs.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """5: keep the document with the smallest doc_id of each class of
    near-duplicates."""
    return ngram_join.first_of_classes(docs, WORDS, PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: drop documents that hold benchmark items."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """3: the mixture, one row for each copy of a document."""
    return mixing.mixture(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language mixtures and tiling are not expressible in SQL; the tests compare
#: run() with a brute-force version.
ORACLE_SQL = None
