"""Putting answered parts together again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_parts(
    answers: DataFrame, keys: Sequence[str], fields: Sequence[str], *, raw: str = "raw", part: str = "part",
    carry: str | None = None,
) -> DataFrame:
    """One map per key: for each field the value of the last part that carries it.

    The field list is known, so one grouping with a partial aggregate does it. A field
    that no part carries stays absent; a part that could not be read leaves no map at
    all. ``carry`` keeps the least value of one more column, for error texts.
    """
    latest = [
        F.max_by(
            F.struct(F.col(raw)[f].alias("v")), F.when(F.map_contains_key(raw, f), F.col(part))
        ).alias(f"__{i}")
        for i, f in enumerate(fields)
    ]
    more = [F.min(carry).alias(carry)] if carry else []
    grouped = answers.groupBy(*keys).agg(F.bool_and(F.col(raw).isNotNull()).alias("__read"), *latest, *more)
    entries = [
        F.when(F.col(f"__{i}").isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f"__{i}.v").alias("value")))
        for i, f in enumerate(fields)
    ]
    merged = F.when(F.col("__read"), F.map_from_entries(F.array_compact(F.array(*entries))))
    return grouped.select(*keys, merged.alias(raw), *([carry] if carry else []))


def latest_by_field(long_rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The same for (key, part, field, value) rows: one column per known field."""
    return long_rows.groupBy(key).agg(
        *[
            F.max_by("value", F.when(F.col("field") == f, F.col("part"))).alias(f)
            for f in fields
        ]
    )
