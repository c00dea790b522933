"""Exact copies by progressive refinement: length, then a hash of the beginning, then a hash of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.shared import ascii_lower
from foliary.operators.keyfilter import key_filter, may_contain
from foliary.session import staged

PREFIX_CHARS = 256


def exact_groups(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", digest_all: bool = False,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, text_sha256, group_size, keep_id, kept.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of a group the row with
    the largest id stays; rows that repeat an id within a group share its fate. A null id stays only where the
    whole group has none. An empty table gives no rows; further columns of ``docs`` are not looked at.

    1. The first pass over the texts takes their lengths and a hash of their beginnings.
    2. Lengths that occur once are settled; among the others, so are the (length, beginning) pairs that occur once.
    3. The second pass hashes the full content of the rows that are left. They are told apart by a bit table of
       fixed size, so no text is shuffled; a row let through in error is only hashed in vain.
    ``digest_all`` adds the digest of every other row for callers that report it; it decides nothing.
    """
    text: Column = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars))).alias("head"), text.alias("content"),
    )
    slim = staged(rows.select("n_bytes", "head"), "exact-heads")
    lengths = key_filter(slim.groupBy("n_bytes").count().where("count > 1").select("n_bytes"))
    left = may_contain(slim, lengths, [F.col("n_bytes")], "again").where("again")
    heads = key_filter(left.groupBy("n_bytes", "head").count().where("count > 1").select("n_bytes", "head"))

    digest = F.sha2(ascii_lower(F.col("content")), 256)
    flagged = may_contain(rows, heads, [F.col("n_bytes"), F.col("head")], "open")
    hashed = staged(
        flagged.select(
            "doc_id", "n_bytes", "open",
            (digest if digest_all else F.when(F.col("open"), digest)).alias("text_sha256"),
        ),
        "exact-digests",
    )
    groups = staged(
        hashed.where("open").groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1"),
        "exact-groups",
    )
    # Rows without a digest get a key of their own, so they do not meet in one task.
    keyed = hashed.withColumn("key", F.coalesce("text_sha256", F.concat(F.lit("row "), F.coalesce("doc_id", F.lit(-1)))))
    groups = groups.select(F.col("text_sha256").alias("key"), "group_size", F.col("keep_id").alias("largest"))
    joined = keyed.join(groups, "key", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return joined.select(
        "doc_id", "n_bytes", "text_sha256", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.alias("keep_id"), keep.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def without_copies(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The keys of the others are joined to the texts: where they are too many for a broadcast, the texts are shuffled once.
    """
    gone = exact_groups(docs, id_column=id_column, text_column=text_column).where(~F.col("kept")).select(
        F.col("doc_id").alias("__gone"), F.col("n_bytes").alias("__bytes"), F.col("text_sha256").alias("__digest")
    ).distinct()
    text = F.coalesce(docs[text_column], F.lit(""))
    # Written as a CASE so that the digest is no join key: it is worked out for the rows with a matching id only.
    same_text = F.when(F.sha2(ascii_lower(text), 256) == F.col("__digest"), F.lit(True)).otherwise(F.lit(False))
    same_row = docs[id_column].eqNullSafe(F.col("__gone")) & (F.octet_length(text) == F.col("__bytes"))
    return docs.join(gone, same_row & same_text, "left_anti")
