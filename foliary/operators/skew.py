"""Joins and row numbers that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.session import staged

# A key is hot when it owns more rows than one task should meet; it is spread over one task per so many rows.
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """(keys, __salts): keys with more than ``rows`` rows and the number of tasks that each is spread over."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > rows).select(*keys, F.ceil(F.col("__n") / max(rows, 1)).cast("int").alias("__salts"))


def is_small(df: DataFrame) -> bool:
    """Whether Catalyst will broadcast ``df`` anyway, by its own estimate."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    *,
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large ``left`` to a ``right`` that is unique per key.

    A right side that Catalyst broadcasts needs no more. Otherwise the keys of ``left`` are counted once and the hot ones
    written down, so ``left`` should be cheap to read twice: stage what is worked out from heavy columns. Without a hot key
    the join is a plain one, left to AQE. Rows of a hot key are spread over tasks of about ``hot_rows`` rows by a hash of
    the ``spread`` columns (stable under task retry); only the matching right rows are copied. The table of hot
    keys is broadcast if it is small, by the size it was written with.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"skew_join keeps left rows only, not how={how!r}")
    keys = list(keys)
    if is_small(right):
        return left.join(right, keys, how)
    hot = staged(hot_keys(left.select(*keys), keys, hot_rows), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    renamed = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], "__salts")

    def flagged(side: DataFrame) -> DataFrame:
        matches = None
        for key in keys:
            same = side[key].eqNullSafe(renamed[f"__h_{key}"])
            matches = same if matches is None else matches & same
        return side.join(renamed, matches, "left").drop(*[f"__h_{k}" for k in keys])

    salts = F.coalesce("__salts", F.lit(1))
    salted = flagged(left).withColumn("__salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
    copied = flagged(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return salted.drop("__salts").join(copied, keys + ["__salt"], how).drop("__salt")


def ordinal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "ordinal",
    *,
    start: int = 1,
    slices: int | None = None,
) -> DataFrame:
    """Row number within ``group`` by ``order``, without putting a group into one task.

    The rows are range-partitioned by group and order, so a large group spans many
    slices. Each slice numbers its own rows; the rows before a slice are added from a
    broadcast table that holds only slices continuing a group: fewer rows than slices.
    """
    columns = df.columns
    group = list(group)
    keyed = df.select(
        "*", *[(c if isinstance(c, Column) else F.col(c)).alias(f"__o{i}") for i, c in enumerate(order)]
    )
    order_keys = [f"__o{i}" for i in range(len(order))]
    sliced = staged(
        keyed.repartitionByRange(*([slices] if slices else []), *group, *order_keys)
        .withColumn("__slice", F.spark_partition_id()),
        "ordinal",
    )

    in_group = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    continued = (
        sliced.groupBy(*group, "__slice")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(in_group))
        .where(F.col("__before") > 0)
        .select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__slice").alias("__s"), "__before")
    )
    in_slice = Window.partitionBy(*group, "__slice").orderBy(*order_keys)
    numbered = sliced.withColumn("__r", F.row_number().over(in_slice))
    same = numbered["__slice"] == continued["__s"]
    for g in group:
        same = same & numbered[g].eqNullSafe(continued[f"__g_{g}"])
    return numbered.join(F.broadcast(continued), same, "left").select(
        *columns,
        (F.col("__r") + F.coalesce("__before", F.lit(0)) + F.lit(start - 1)).cast("long").alias(name),
    )
