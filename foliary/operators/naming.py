"""Unique target names inside a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.operators.skew import ordinal, skew_join
from foliary.session import staged

_NUMBERED = r"\A(.+)_([1-9][0-9]{0,17})\z"


def unique_names(
    files: DataFrame, folder: str, base: str, order: Sequence[str], out: str = "name", existing: DataFrame | None = None
) -> DataFrame:
    """``base``, ``base_1``, ``base_2`` ... by ``order``, skipping names another file really has and those of ``existing``.

    ``existing`` has the columns ``folder`` and ``base`` too: names that stand in the target already. The first file of a
    base keeps it unless it stands there. The n-th further file of a base gets the n-th number whose name is neither a real
    base nor there. Those numbers come from numbering the files and the taken names together, so no loop is needed
    and a base of any size is spread over many tasks. Null folders and bases are names like others, but meet no existing one.
    """
    # Written once: the ranks are read for the bases, the taken names and the rows themselves.
    rows = staged(ordinal(files, [folder, base], order, "__rank", start=0), "ranked-names")
    bases = rows.where("__rank = 0").select(folder, base)

    def numbered(names: DataFrame) -> DataFrame:
        """Of each name with a number at its end the base and the number."""
        return names.where(F.col(base).rlike(_NUMBERED)).select(
            folder, F.regexp_extract(base, _NUMBERED, 1).alias(base),
            F.regexp_extract(base, _NUMBERED, 2).cast("long").alias("__k"),
        )

    taken = numbered(bases)
    if existing is not None:
        there = existing.select(folder, base)
        taken = taken.unionByName(there.withColumn("__k", F.lit(0).cast("long"))).unionByName(numbered(there)).distinct()
    taken = taken.join(bases, [folder, base], "left_semi")
    # The j-th taken number k, the base itself being 0, stands after the files whose rank is at most k - j.
    blockers = ordinal(taken, [folder, base], ["__k"], "__j").select(
        folder, base, (F.col("__k") - F.col("__j")).alias("__at"), F.lit(1).alias("__taken"), F.col("__k").alias("__t")
    )
    blocked = blockers.select(folder, base).distinct().withColumn("__blocked", F.lit(True))
    marked = skew_join(rows, blocked, [folder, base], "left", spread=list(order))

    free = marked.where("__blocked is null").withColumn("__slot", F.col("__rank"))
    mixed = marked.where("__blocked").withColumns(
        {"__at": F.col("__rank"), "__taken": F.lit(0), "__t": F.col("__rank")}
    )
    slots = ordinal(
        mixed.unionByName(blockers, allowMissingColumns=True), [folder, base], ["__at", "__taken", "__t"], "__slot", start=0
    ).where("__taken = 0")
    name = F.when(F.col("__slot") == 0, F.col(base)).otherwise(F.concat_ws("_", base, F.col("__slot").cast("string")))
    return free.unionByName(slots.select(*free.columns)).select(*files.columns, name.alias(out))
