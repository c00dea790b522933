"""Hash trees over a table: every level joins its nodes to their siblings, and the first of each run emits the parent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.operators.skew import ordinal
from foliary.session import staged

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A step of a path: the digests before and after a node in its run.
PATH = "array<struct<before: array<binary>, after: array<binary>>>"
# Levels whose paths are handed down in one plan before they are written.
LEVELS_PER_PLAN = 6


def hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """Digests as hex text, one after the other."""
    return F.array_join(F.transform(digests, as_text), "")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hash of the fields: ``-`` for null, otherwise UTF-8 byte count, colon and value, so no two rows read alike."""
    texts = [f.cast("string") for f in fields]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def tree_key(source: Column) -> Column:
    """A name that is never null and orders as UTF-8 bytes do, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, position, digest, ...) with slot, the digests before and after in the run, and whether a node is alone.

    One equijoin per other slot on (tree, computed position of the sibling): by exclusive or for pairs, by offset from
    the run's first place otherwise. The keys are unique, so no key is hot whatever the sizes of the trees.
    """
    slot = F.pmod("position", F.lit(arity))
    out = nodes.withColumn("slot", slot)
    for shift in range(1, arity):
        place = F.col("position").bitwiseXOR(F.lit(1)) if arity == 2 else (
            F.col("position") - F.col("slot") + F.pmod(F.col("slot") + shift, F.lit(arity))
        )
        beside = nodes.select(
            F.col("tree").alias("__tree"), F.col("position").alias("__place"), F.col("digest").alias(f"__at{shift}")
        )
        out = out.withColumn("__to", place)
        out = out.join(beside, (out["tree"] == beside["__tree"]) & (out["__to"] == beside["__place"]), "left")
        out = out.drop("__tree", "__place", "__to")
    # The sibling ``shift`` places on lies before the node where the run wraps round.
    shifts = range(1, arity)
    before = F.array_compact(F.array(*[F.when(F.col("slot") >= arity - s, F.col(f"__at{s}")) for s in shifts]))
    after = F.array_compact(F.array(*[F.when(F.col("slot") < arity - s, F.col(f"__at{s}")) for s in shifts]))
    out = out.withColumns({"before": before, "after": after}).drop(*[f"__at{s}" for s in shifts])
    return out.withColumn("alone", (F.col("position") == 0) & (F.size("after") == 0))


@dataclass
class Forest:
    """The written levels of all trees, leaves first. The one node of a level that is ``alone`` is its tree's root."""

    levels: list[DataFrame]
    arity: int

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        found = [level.where("alone").select("tree", "digest") for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out


def forest(leaves: DataFrame, arity: int = ARITY) -> Forest:
    """Builds every tree of ``leaves`` (tree, position from 0 without gaps, digest, further columns) at the same time.

    A level has an ``arity``-th of the rows of the one below. The number of levels follows from the largest position;
    small trees are done after their own and leave the loop.
    """
    if arity < 2:
        raise ValueError("a run holds two nodes at least")
    levels = [staged(with_siblings(leaves, arity), "merkle-level")]
    nodes = (levels[0].agg(F.max("position")).first()[0] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // arity)
        parents = levels[-1].where("slot = 0 and not alone").select(
            "tree", F.floor(F.col("position") / arity).cast("long").alias("position"),
            hashed(joined(F.concat(F.array("digest"), "after"))).alias("digest"),
        )
        levels.append(staged(with_siblings(parents, arity), "merkle-level"))
    return Forest(levels, arity)


def paths(grown: Forest, beyond: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Leaves (tree, position, digest, ``keep``) with ``subroot`` and ``path``: the siblings met on the way up, level by level.

    ``beyond`` (tree, further) goes on from a tree's root with the path of a tree of trees. From the top down each
    level is joined to its parents, so a path is copied once per level and not once per leaf and level.
    """
    above = None
    for number, level in reversed(list(enumerate(grown.levels))):
        columns = ["tree", "position", "digest", *(keep if number == 0 else ())]
        ends = level.where("alone").select(*columns, F.col("digest").alias("subroot"))
        if beyond is None:
            ends = ends.withColumn("path", F.array().cast(PATH))
        else:
            ends = ends.join(beyond.select("tree", F.col("further").alias("path")), "tree")
        rows = ends.select(*columns, "subroot", "path")
        if above is not None:
            parents = above.select(
                F.col("tree").alias("__tree"), F.col("position").alias("__parent"), "subroot", F.col("path").alias("__path")
            )
            inner = level.where("not alone").withColumn("__up", F.floor(F.col("position") / grown.arity).cast("long"))
            inner = inner.join(parents, (inner["tree"] == parents["__tree"]) & (inner["__up"] == parents["__parent"]))
            step = F.array(F.struct("before", "after")).cast(PATH)
            rows = rows.union(inner.withColumn("path", F.concat(step, "__path")).select(*columns, "subroot", "path"))
        above = staged(rows, "merkle-paths") if number and number % LEVELS_PER_PLAN == 0 else rows
    return above


def folded(digest: Column, path: Column) -> Column:
    """The root that ``digest`` leads to with the siblings of ``path``."""
    return F.aggregate(
        path, digest, lambda node, step: hashed(joined(F.concat(step["before"], F.array(node), step["after"])))
    )


def path_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level and from left to right, as hex text."""
    return F.sha2(joined(F.flatten(F.transform(path, lambda step: F.concat(step["before"], step["after"])))), 256)


def manifest(
    docs: DataFrame, *, fields: Sequence[str] = FIELDS, id_column: str = "doc_id", source_column: str = "source",
    arity: int = ARITY, altered: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, altered_leaf, subroot, root (binary) and path.

    A leaf hashes the named columns. The leaves of a source, by id (null first) and then by leaf, form a tree; the
    roots of the trees, by source (null first, as UTF-8 bytes), form the tree of trees, so a change of one source touches
    one tree and the few nodes above. A run of one node is hashed too; a lone leaf is its tree's root as it is.
    Repeated rows are leaves each; an empty table gives no rows; columns not named are not looked at.

    ``altered`` is a column that stands for ``text`` in a second leaf of the same row (a copy to be checked); null means
    no such copy, and the original leaf is used. Texts are read once and never shuffled: what moves is one digest
    per node and level, and the paths.
    """
    plain = [F.col(c) for c in fields]
    leaf = leaf_digest(plain)
    other = leaf if altered is None else F.when(
        altered.isNotNull(), leaf_digest([altered if c == "text" else F.col(c) for c in fields])
    ).otherwise(leaf)
    # Three columns of the caller's and names of our own: what else ``docs`` holds cannot clash.
    slim = docs.select(
        tree_key(F.col(source_column)).alias("tree"), F.col(id_column).alias("doc_id"), leaf.alias("digest"),
        other.alias("altered_leaf"),
    )
    numbered = ordinal(slim, ["tree"], ["doc_id", "digest", "altered_leaf"], "position", start=0)
    trees = forest(numbered, arity)
    tops = forest(
        ordinal(trees.roots(), [], ["tree"], "position", start=0)
        .select(F.lit("").alias("tree"), "position", "digest", F.col("tree").alias("of")), arity,
    )
    root = tops.roots().first()
    beyond = staged(paths(tops, keep=["of"]).select(F.col("of").alias("tree"), F.col("path").alias("further")), "merkle-tops")
    found = paths(trees, beyond, keep=["doc_id", "altered_leaf"])
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "altered_leaf", "subroot",
        F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"), "path",
    )
