"""A corpus from raw documents to tokens: rules, exact and near copies, the mix, encoding.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, as a
table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from framelake.llm.common import Scratch, documents


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, trusting those that are labelled good."""
    return quality_rules.keep(docs, quality_rules.trusted_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles make alike by 0.8 or more."""
    return near_dedup.dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a document, with the words taken."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, bpe.vocabulary())


STAGES = [("quality_rules", rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixture), ("bpe", tokens)]

#: Hashed ratios, MinHash components and permutations are no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
