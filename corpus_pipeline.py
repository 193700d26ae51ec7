"""A training corpus from `documents`: five stages, each written as Parquet and read again.

quality      documents whose top grade is unlikely go (ordinal cumulative-link regression)
near_dedup   one document of each near-duplicate group stays, the one with the smallest id
             (SimHash over five-word shingles, linked within seven bits)
decontaminate documents into which a benchmark item leaks go
secrets      owner-specific secrets are taken out of the texts; every document stays
packing      what is left, packed into sequences of at most 2048 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import decontaminate as decontamination
from meridian.llm import packing as packer
from meridian.llm import quality as classifier
from meridian.llm import secret_scan, simhash
from meridian.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_best(docs, classifier.grades(table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packer.pack(docs, packer.tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL expresses neither the fitted classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
