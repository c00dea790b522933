"""Logged conversations: snapshots that a longer log continues are dropped, the others are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.operators.skew import ordinal
from foliary.session import staged

TURNS_PER_BLOCK = 1024


def turn_digests(turns: DataFrame) -> DataFrame:
    """Distinct turns as (conv_id, turn, role, digest); a turn logged twice is one turn."""
    return turns.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("\0null")).cast("binary")).alias("digest")).distinct()


def rolling(turns: DataFrame) -> DataFrame:
    """Every turn with its position from 0, its block and the hashes of the turns up to it.

    A prefix hash is the running xor of hashes that contain the position, so it is summed up per block of
    ``TURNS_PER_BLOCK`` turns first and then over blocks: a conversation of any length never meets in one task.
    """
    names = ["turn", "role", "digest"]
    placed = ordinal(turn_digests(turns), ["conv_id"], names, "position", start=0)
    tagged = staged(
        placed.select(
            "conv_id", *names, "position", F.floor(F.col("position") / TURNS_PER_BLOCK).cast("long").alias("block"),
            *[
                F.xxhash64(F.lit(seed), F.col("position"), F.coalesce("role", F.lit("\0null")), F.col("digest")).alias(f"h{seed}")
                for seed in (1, 2)
            ],
        ),
        "chat-turns",
    )
    in_block = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of more than one block have rows here.
    before = (
        tagged.groupBy("conv_id", "block").agg(*[F.bit_xor(f"h{s}").alias(f"b{s}") for s in (1, 2)])
        .select("conv_id", "block", *[F.bit_xor(f"b{s}").over(earlier).alias(f"before{s}") for s in (1, 2)])
        .where(F.col("before1").isNotNull())
        .select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), "before1", "before2")
    )
    within = tagged.select(
        "conv_id", *names, "position", "block", *[F.bit_xor(f"h{s}").over(in_block).alias(f"in{s}") for s in (1, 2)]
    )
    joined = within.join(before, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")), "left")
    return joined.select(
        "conv_id", *names, "position", "block",
        *[F.col(f"in{s}").bitwiseXOR(F.coalesce(f"before{s}", F.lit(0))).alias(f"p{s}") for s in (1, 2)],
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that no longer one continues; of equal ones the smallest id.

    ``prefixes`` are the rows of ``rolling``.
    """
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("position", "p1", "p2"), "position").alias("last")).select(
        "conv_id", "last.*"
    )
    whole = last.groupBy("position", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    lengths = last.select(F.col("conv_id").alias("__c"), F.col("position").alias("__last"))
    proper = (
        prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("__c")))
        .where(F.col("position") < F.col("__last")).select("position", "p1", "p2").distinct()
    )
    return whole.join(proper, ["position", "p1", "p2"], "left_anti").select(
        "conv_id", (F.col("position") + 1).alias("n_turns"), "copies"
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies, text of every maximal conversation of (conv_id, turn, role, text).

    Turns stand in the order of turn (null first), role (null first) and the md5 of the text; rows that repeat
    all of these are one turn. A turn reads ``<|role|>``, a line break, its text, a line break; a null role is
    ``unknown``, a null text empty. Rows without a conv_id form one conversation. A text is cut into parts of
    ``TURNS_PER_BLOCK`` turns, numbered from 0, so that no row grows without bound. An empty table gives no rows;
    further columns are not looked at.
    """
    places = staged(rolling(turns), "chat-places")
    kept = maximal(places).select(F.col("conv_id").alias("__c"), "n_turns", "copies")
    chosen = places.join(kept, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    texts = turns.select(
        "conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("\0null")).cast("binary")).alias("digest"), "text"
    ).groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"))
    renamed = texts.select(*[F.col(c).alias(f"__{c}") for c in texts.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("conv_id", "turn", "role", "digest")]
    piece = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("__text", F.lit("")), F.lit("\n")
    )
    joined = chosen.join(renamed, same[0] & same[1] & same[2] & same[3]).withColumn("piece", F.struct("position", piece.alias("said")))
    return joined.groupBy("conv_id", F.col("block").alias("part"), "n_turns", "copies").agg(
        F.array_join(F.array_sort(F.collect_list("piece"))["said"], "").alias("text")
    )
