"""A bit table of keys: tells rows that certainly lack a key apart where they stand, so they enter no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A filter holds 2^26 bits in rows of 2^15 bits: never more than 2048 rows of 4 KB.
FILTER_BITS = 1 << 26
ROW_BITS = 1 << 15


def filter_slot(keys: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1


def key_filter(keys: DataFrame) -> DataFrame:
    """The bits of the rows of ``keys``: at most 8 MB however many keys there are."""
    slots = keys.select(filter_slot([F.col(c) for c in keys.columns]).alias("slot"))
    return slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("__bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("__bits")
    )


def may_contain(df: DataFrame, bits: DataFrame, keys: Sequence[Column], flag: str) -> DataFrame:
    """``df`` with a flag: false where the keys are certainly not in the filter. Nothing but the filter moves."""
    slot = filter_slot(keys)
    place = F.pmod(slot - 1, F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    # Bit k of a byte is byte / 2^k mod 2.
    bit = F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))) % 2 == 1
    bucket = (F.floor((slot - 1) / ROW_BITS) + 1).cast("long")
    return (
        df.join(F.broadcast(bits), bucket == F.col("__bucket"), "left")
        .withColumn(flag, F.coalesce(bit, F.lit(False)))
        .drop("__bucket", "__bits")
    )
