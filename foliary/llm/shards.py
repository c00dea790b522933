"""Reproducible shuffle into shards: a keyed permutation of global row numbers, so shard and slot are computed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.operators.skew import ordinal

ROUNDS = 6


def grid(total: int) -> tuple[int, int]:
    """Two factors near the square root of ``total`` whose product exceeds it by as little as possible.

    The product minus ``total`` bounds the length of a cycle walk; the search is arithmetic on the total alone.
    """
    root = max(1, math.isqrt(max(total, 1) - 1) + 1)
    low = max(1, root // 4, root - 1_000_000)
    best = min(range(root, low - 1, -1), key=lambda a: (-total % a, -a))
    return best, max(1, -(-total // best))


def permuted(number: Column, rows: int, columns: int, key: int) -> Column:
    """One pass of an alternating Feistel network over the numbers below ``rows * columns``."""
    left, right = F.floor(number / columns).cast("long"), F.pmod(number, F.lit(columns))
    for turn in range(ROUNDS):
        if turn % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(key), F.lit(turn)), F.lit(rows)), F.lit(rows))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(key), F.lit(turn)), F.lit(columns)), F.lit(columns))
    return (left * columns + right).cast("long")


def place(number: Column, total: int, key: int) -> Column:
    """The place of row ``number`` in a permutation of 0 to ``total - 1``.

    The network permutes a slightly larger range; a result beyond the last row is sent through again until it
    falls inside. A walk meets each number outside at most once, so the number of steps below is enough always.
    """
    rows, columns = grid(total)
    first = permuted(number, rows, columns, key)
    outside = rows * columns - total
    if not outside:
        return first
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(outside)), first,
        lambda at, _: F.when(at < total, at).otherwise(permuted(at, rows, columns, key)),
    )


def shuffled_shards(
    docs: DataFrame, shards: int = 24, *, key: int = 20240229, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, place.

    Rows are numbered by id (nulls first), then by check sum and size; rows alike in all three are interchangeable.
    The permuted number gives the shard as remainder and the slot as quotient, so shard sizes differ by at most one
    row and slots have no gaps, whatever the sources or copies. A null text counts as empty. An empty table gives
    no rows. Only three narrow columns are shuffled, never a text.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_column), F.lit(""))
    slim = docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    total = docs.count()
    number = ordinal(slim, [], ["doc_id", "text_crc32", "size"], "number", start=0)
    placed = number.withColumn("place", place(F.col("number"), total, key))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "place",
    )
