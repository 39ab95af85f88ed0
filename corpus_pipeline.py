"""The training-data pipeline over documents. A stage is a function (spark, docs, sf_dir) -> DataFrame.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, further columns of any name, and no rows at
all; an empty table stays empty. All but the last keep the columns of ``docs`` and their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, decontaminate, prob_minhash, robust_outliers, secret_links
from quillon.llm.queries import RANKS
from quillon.llm.tables import small_batches, written
from quillon.session import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source. Null and empty texts fail the base
    rules; rows that repeat share their verdict; null languages and sources are groups of their own."""
    return robust_outliers.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id (null last). Of rows that repeat its id and text one
    stays; texts without words are copies only if equal, and null texts of none."""
    return prob_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none and stay; rows that repeat stay or go together."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows a changed text. A null text stays null."""
    marked = secret_links.redact(docs.withColumn("_before", F.length("text")))
    n = F.when(F.length("text") != F.col("_before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n).select(*docs.columns)


def byte_bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document, a row each, repeated ones too. A null text is empty."""
    with small_batches(spark):
        return written(byte_bpe.token_digests(docs, RANKS), "tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe_tokens),
]

#: Estimates, sketches and tokens of the stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over documents, each written and reread."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
