"""Documents to packed windows, in stages that each work on all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliary.llm.decontaminate import without_leaks
from foliary.llm.exact import without_copies
from foliary.llm.jaccard import one_of_each_group
from foliary.llm.language import known_language
from foliary.llm.packing import pack
from foliary.session import new_folder

# What makes a near copy here; the query of operator 5 has a rule of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word n-grams link: five words, Jaccard 0.8."""
    return one_of_each_group(docs, shingle=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows of tokens."""
    return pack(docs)


STAGES = [
    ("language", language), ("exact copies", exact_copies), ("near copies", near_copies),
    ("benchmark leaks", benchmark_leaks), ("packing", packed_windows),
]
# SQL can express neither the classifier nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
