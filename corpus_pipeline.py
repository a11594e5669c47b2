"""Corpus pipeline: quality filter, exact dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, decontaminate, exact_dedup, quality, simhash
from brindle.llm.queries import tokenizer
from brindle.session import give_back, scope, unstash


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return bpe.bpe_encode(docs, tokenizer())


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("bpe encoding", encode),
]
#: The classifier, the fingerprints and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written and read again; what a stage wrote besides is deleted."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scope(spark) as sc:
            docs = sc.keep(stage(spark, docs, sf_dir))
        if held is not None:
            unstash(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
