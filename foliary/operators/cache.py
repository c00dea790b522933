"""The answer table: keyed lookups, misses, union and append.

Rows are (request_key, response_json, created_at), partitioned by the first two hex
digits of the key. Inside a file they stand in the order of their keys, in small pages with bounds, and
every row group has a Bloom filter of its keys: a lookup of few keys reads few folders, and of them the row groups
and pages that can hold a key. Runs that overlap may append one key twice; every lookup takes
the newest row of a key, so results never multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators.skew import skew_join

CACHE_SCHEMA = "request_key string, response_json string, created_at timestamp_ntz, prefix string"
PREFIX_LENGTH = 2
# Up to so many keys go to the scan as a filter; more are joined.
FEW_KEYS = 4096
# Equal keys tested one by one in a single filter: beyond ten the reader only compares with the least and the greatest.
KEYS_PER_TEST = 10
INDEXED = {
    "parquet.bloom.filter.enabled#request_key": "true", "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.block.size": str(16 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "64",
}


def empty_cache(spark: SparkSession) -> DataFrame:
    """A cache without rows, which the optimizer takes out of a plan."""
    none = F.lit(None)
    return spark.range(1).where(F.lit(False)).select(
        none.cast("string").alias("request_key"), none.cast("string").alias("response_json"),
        none.cast("timestamp_ntz").alias("created_at"),
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def latest(cache: DataFrame) -> DataFrame:
    """(request_key, response_json), one row per key: the newest, of equally new ones the largest answer."""
    age = [F.col("created_at")] if "created_at" in cache.columns else []
    newest = F.max_by("response_json", F.struct(*age, "response_json"))
    return cache.groupBy("request_key").agg(newest.alias("response_json"))


def narrowed(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The part of the cache that can hold any of the keys, by their at most 256 prefixes and, if they are few, by themselves."""
    if "prefix" not in cache.columns:
        return cache
    prefix = F.substring("request_key", 1, PREFIX_LENGTH).alias("prefix")
    asked = keys.select("request_key").where("request_key is not null").distinct()
    found = {r["prefix"]: r["n"] for r in asked.groupBy(prefix).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return cache.where(F.lit(False))
    inside = cache.where(F.col("prefix").isin(sorted(found)))
    if sum(found.values()) > FEW_KEYS:
        return inside
    few = sorted(r["request_key"] for r in asked.collect())
    tests = [F.col("request_key").isin(few[i: i + KEYS_PER_TEST]) for i in range(0, len(few), KEYS_PER_TEST)]
    return inside.where(_any(tests))


def _any(tests: list[Column]) -> Column:
    """One of the tests holds; as a balanced tree, since a chain of hundreds would be as deep."""
    half = len(tests) // 2
    return tests[0] if len(tests) == 1 else _any(tests[:half]) | _any(tests[half:])


def hits(requests: DataFrame, cache: DataFrame, spread: list[str]) -> DataFrame:
    """Every request with its cached answer, or null."""
    known = latest(narrowed(cache, requests))
    return skew_join(requests, known, ["request_key"], "left", spread=spread)


def misses(requests: DataFrame, cache: DataFrame, representative: str) -> DataFrame:
    """Each unanswered key once, with the smallest ``representative`` that asks for it."""
    asked = requests.groupBy("request_key").agg(F.min(representative).alias(representative))
    return asked.join(narrowed(cache, requests).select("request_key"), "request_key", "left_anti")


def asked_of(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_key, response_json) of the cached answers that any of the requests asks for, once each."""
    keys = requests.select("request_key").distinct()
    return latest(narrowed(cache, keys).join(keys, "request_key", "left_semi"))


def all_answers(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    return cached.select("request_key", "response_json").unionByName(fresh.select("request_key", "response_json"))


def new_entries(fresh: DataFrame, existing: DataFrame, created_at: str) -> DataFrame:
    """Fresh answers to append: unique on the key and not yet in the table."""
    return (
        fresh.where("response_json is not null")
        .groupBy("request_key")
        .agg(F.min("response_json").alias("response_json"))
        .join(narrowed(existing, fresh).select("request_key"), "request_key", "left_anti")
        .select(
            "request_key",
            "response_json",
            F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
            F.substring("request_key", 1, PREFIX_LENGTH).alias("prefix"),
        )
    )


def append(entries: DataFrame, path: str) -> None:
    """Append new entries; one writer at a time keeps the key unique.

    Rebalancing puts a small prefix into one file and splits a large one.
    """
    sorted_rows = entries.hint("rebalance", "prefix").sortWithinPartitions("prefix", "request_key")
    sorted_rows.write.mode("append").options(**INDEXED).partitionBy("prefix").parquet(path)
