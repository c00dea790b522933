"""Choosing a record type by walking down a tree of types."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import join_path
from foliary.operators.skew import skew_join
from foliary.session import new_folder, staged

# A registry of more bytes than this is joined without a broadcast.
BROADCAST_BYTES = 8 << 20
# Bytes of text in a bucket of standing texts.
BUCKET_BYTES = 64 << 20


@dataclass(frozen=True)
class TypeNode:
    """A record type: its key, the key of its first parent, and words that speak for it."""

    key: str
    parent: str | None = None
    keywords: tuple[str, ...] = ()

    @property
    def class_name(self) -> str:
        return self.key.rsplit("_", 1)[-1]


CANDIDATE = "struct<ord:int,key:string,class_name:string>"
Chooser = Callable[[Column, Column], Column]
Asker = Callable[[DataFrame], DataFrame]


def _candidates(nodes: Sequence[tuple[int, TypeNode]]) -> Column:
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(n.key).alias("key"), F.lit(n.class_name).alias("class_name"))
        for i, n in nodes
    ]
    return F.array(*rows) if rows else F.array().cast(f"array<{CANDIDATE}>")


def tree_depth(tree: Sequence[TypeNode]) -> int:
    parents = {n.key: n.parent for n in tree}

    def depth(key: str | None) -> int:
        return 0 if key is None or key not in parents else 1 + depth(parents[key])

    return max((depth(n.key) for n in tree), default=0)


def ancestry(tree: Sequence[TypeNode], key: str) -> list[str]:
    """Root-to-leaf class names of a type."""
    nodes = {n.key: n for n in tree}
    line: list[str] = []
    at: str | None = key
    while at in nodes:
        line.insert(0, nodes[at].class_name)
        at = nodes[at].parent
    return line


def resolved(choice: Column, candidates: Column) -> Column:
    """The candidate key a chosen name stands for: exact key, else first key or class name ignoring case."""
    exact = F.filter(candidates, lambda c: c["key"] == choice)
    loose = F.filter(
        candidates, lambda c: (F.lower(c["key"]) == F.lower(choice)) | (F.lower(c["class_name"]) == F.lower(choice))
    )
    return F.coalesce(F.get(exact, 0)["key"], F.get(loose, 0)["key"])


def resolve_names(rows: DataFrame, name: str, tree: Sequence[TypeNode], out: str = "type_key") -> DataFrame:
    """The same against the whole registry, as two joins; broadcast while the registry is small in bytes."""
    exact = {n.key: n.key for n in tree}
    loose: dict[str, str] = {}
    for n in tree:
        loose.setdefault(n.key.lower(), n.key)
        loose.setdefault(n.class_name.lower(), n.key)
    spark = rows.sparkSession
    by_key = spark.createDataFrame(list(exact.items()), "__n string, __exact string")
    by_lower = spark.createDataFrame(list(loose.items()), "__l string, __loose string")
    if sum(len(n.key.encode()) for n in tree) * 4 <= BROADCAST_BYTES:
        by_key, by_lower = F.broadcast(by_key), F.broadcast(by_lower)
    return (
        rows.join(by_key, F.col(name) == F.col("__n"), "left")
        .join(by_lower, F.lower(name) == F.col("__l"), "left")
        .withColumn(out, F.coalesce("__exact", "__loose"))
        .drop("__n", "__exact", "__l", "__loose")
    )


def children_of(types: DataFrame, parent_key: str) -> DataFrame:
    """Types whose first parent is ``parent_key``."""
    return types.where(F.col("parent_key") == parent_key)


def with_children(types: DataFrame) -> DataFrame:
    """Every type with each of its direct children, or null for a leaf."""
    children = types.select(F.col("parent_key").alias("__p"), F.col("type_key").alias("child_key"))
    return types.join(children, F.col("type_key") == F.col("__p"), "left").drop("__p")


def keyword_scores(text: Column, tree: Sequence[TypeNode]) -> Column:
    """Keyword hits per type, in registry order; the text is lowered once and never moves."""

    def counted(low: Column) -> Column:
        scores = []
        for node in tree:
            total = F.lit(0)
            for word in node.keywords:
                removed = F.octet_length(low) - F.octet_length(F.replace(low, F.lit(word), F.lit("")))
                total = total + (removed / len(word.encode())).cast("int")
            scores.append(total)
        return F.array(*scores)

    return _with(F.lower(text), counted)


def by_score(candidates: Column, scores: Column) -> Column:
    """Choose the candidate with most hits, the earlier one on a tie, none without hits."""
    ranked = F.transform(
        candidates,
        lambda c: F.struct(F.get(scores, c["ord"]).alias("score"), (-c["ord"]).alias("earlier"), c["key"].alias("key")),
    )
    return F.array_max(F.filter(ranked, lambda r: r["score"] > 0))["key"]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _offers(tree: Sequence[TypeNode], roots_only: bool) -> tuple[Column, Column]:
    """(candidates of the first phase, candidates by parent) as constants."""
    numbered = list(enumerate(tree))
    by_parent: list[Column] = []
    for parent in dict.fromkeys(n.parent for n in tree if n.parent is not None):
        by_parent += [F.lit(parent), _candidates([(i, n) for i, n in numbered if n.parent == parent])]
    children = F.create_map(*by_parent) if by_parent else F.create_map().cast(f"map<string,array<{CANDIDATE}>>")
    return _candidates([(i, n) for i, n in numbered if not roots_only or n.parent is None]), children


def _offered(path: Column, first: Column, children: Column) -> Column:
    """What may be chosen after ``path``; an empty array at a leaf."""
    none = F.array().cast(f"array<{CANDIDATE}>")
    last = F.get(path, F.size(path) - 1)
    return F.when(F.size(path) == 0, first).otherwise(F.coalesce(children[last], none))


def _outcome(rows: DataFrame, first_choice: Column) -> DataFrame:
    """type_key, path_text, status and error_message from selection_path."""
    chosen = F.size("selection_path") > 0
    wrong = F.concat(F.lit("invalid type: "), F.coalesce(first_choice, F.lit("")))
    return rows.withColumns(
        {
            "type_key": F.get(F.col("selection_path"), F.size("selection_path") - 1),
            "path_text": join_path(F.col("selection_path")),
            "status": F.when(chosen, "ok").otherwise("failed"),
            "error_message": F.when(~chosen, wrong),
        }
    )


def classified(
    docs: DataFrame, tree: Sequence[TypeNode], given: Column, chooser: Chooser = by_score, *, roots_only: bool = False
) -> DataFrame:
    """Walk down the tree: choose among the candidates, resolve, append, go on with its children.

    ``given`` is worked out once per document (such as ``keyword_scores``) and handed to
    the chooser in every phase.

    A first choice that fits no candidate is a failure; a later one ends the walk.
    Adds selection_path, type_key, path_text, status and error_message. The chooser is
    an expression, so the walk is one too: documents never move.
    """
    first, children = _offers(tree, roots_only)
    start = F.struct(
        F.array().cast("array<string>").alias("path"), F.lit(True).alias("open"), F.lit(None).cast("string").alias("first")
    )

    def step(state: Column, phase: Column, known: Column) -> Column:
        def choose(offer: Column) -> Column:
            return _with(chooser(offer, known), lambda choice: settle(choice, resolved(choice, offer)))

        def settle(choice: Column, key: Column) -> Column:
            return _with(
                key,
                lambda k: F.struct(
                    F.when(k.isNull(), state["path"]).otherwise(F.concat(state["path"], F.array(k))).alias("path"),
                    k.isNotNull().alias("open"),
                    F.when(phase == 1, choice).otherwise(state["first"]).alias("first"),
                ),
            )

        return F.when(state["open"], _with(_offered(state["path"], first, children), choose)).otherwise(state)

    phases = F.sequence(F.lit(1), F.lit(max(tree_depth(tree), 1)))
    walk = _with(given, lambda known: F.aggregate(phases, start, lambda state, phase: step(state, phase, known)))
    walked = docs.withColumn("__walk", walk).withColumn("selection_path", F.col("__walk.path"))
    return _outcome(walked, F.col("__walk.first")).drop("__walk")


CONTENT, TEXT = "__content", "text"


def standing_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(__content, text): every different text once, written in buckets by its key.

    This is the only time that texts are exchanged, copies of a text meeting in a partial aggregate first: joins by the
    key then move the other side alone.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(content_key(F.col(text)).alias(CONTENT), F.col(text).alias(TEXT))
    once = keyed.groupBy(CONTENT).agg(F.first(TEXT).alias(TEXT)).repartition(buckets, CONTENT)
    name = f"standing_texts_{uuid.uuid4().hex}"
    once.write.bucketBy(buckets, CONTENT).sortBy(CONTENT).option("path", new_folder(spark, "standing-texts")).saveAsTable(name)
    return spark.table(name)


def content_key(text: Column) -> Column:
    """The key of a text; no text has the one of null."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def under_way(texts: DataFrame, offered: DataFrame) -> DataFrame:
    """Texts with what is offered to them: only ``offered`` moves."""
    return texts.join(offered.hint("merge"), CONTENT)


def classified_by_calls(
    docs: DataFrame, tree: Sequence[TypeNode], ask: Asker, *, doc_id: str = "doc_id", text: str = "text",
    roots_only: bool = False,
) -> DataFrame:
    """The same walk with a provider that answers rows, one row per row of ``docs``: doc_id, selection_path, type_key, ...

    ``ask`` turns (doc_id, text, selection_path, offered) into (doc_id, choice); the id it sees is the library's own key of a
    text, because ids of the caller may repeat or be null. A text is asked about once per phase however many rows have it.
    Each phase writes its answers down, so no call is repeated when an executor is lost. Only keys and paths move
    from phase to phase, the texts stand still.
    """
    first, children = _offers(tree, roots_only)
    texts = standing_texts(docs, text)
    state = texts.select(
        CONTENT, F.array().cast("array<string>").alias("selection_path"), F.lit(True).alias("open"),
        F.lit(None).cast("string").alias("first"),
    )
    for phase in range(1, tree_depth(tree) + 1):
        offered = state.where("open").withColumn("offered", _offered(F.col("selection_path"), first, children))
        offered = offered.where(F.size("offered") > 0).select(CONTENT, "selection_path", "offered")
        asked = under_way(texts, offered).withColumnRenamed(CONTENT, doc_id)
        choices = staged(ask(asked).select(F.col(doc_id).alias(CONTENT), "choice"), "choices")
        answered = offered.drop("selection_path").join(choices, CONTENT)
        keys = answered.select(CONTENT, "choice", resolved(F.col("choice"), F.col("offered")).alias("key"))
        state = staged(
            state.join(keys, CONTENT, "left").select(
                CONTENT,
                F.when(F.col("key").isNull(), F.col("selection_path"))
                .otherwise(F.concat("selection_path", F.array("key"))).alias("selection_path"),
                (F.col("open") & F.col("key").isNotNull()).alias("open"),
                (F.col("choice") if phase == 1 else F.col("first")).alias("first"),
            ),
            "classified",
        )
    ended = _outcome(state.drop("open"), F.col("first")).drop("first")
    slim = docs.select(doc_id, content_key(F.col(text)).alias(CONTENT))
    return skew_join(slim, ended, [CONTENT], "left", spread=[doc_id]).drop(CONTENT)
