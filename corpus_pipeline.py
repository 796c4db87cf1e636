"""From raw documents to token digests of a clean corpus, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads again as the next one's documents. All stages but the last return the columns of
documents. An empty table passes every stage; what a stage does with nulls, ties and repeated rows is in its operator's
docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, decontaminate, ngram_join, pii, rule_ensemble
from quarry.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; it learns from the labels of the documents that are there."""
    return rule_ensemble.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.8 connect, the one with the smallest doc_id stays."""
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document."""
    return byte_bpe.encoded(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: Neither the fit, nor alignment, nor byte-pair merges can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
