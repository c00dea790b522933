"""Typed records to shared entity tables and flat record tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.operators.entities import (
    ATTRIBUTES, clean_name, entity_id, flat_value, harvested, merged_entities, reference_fields,
)
from foliary.sinks.snapshots import Snapshots, merged, with_part

ORDER = ("batch", "path", "pos")
ENTITY_TABLE, ENTITY_KEYS = "entities", ("entity", "name")


@dataclass(frozen=True)
class Normalised:
    records: DataFrame
    mentions: DataFrame


def normalise(
    records: DataFrame, record: T.StructType, path: str, *, metadata: str | None = None, exact_only: bool = False,
    batch: int = 0,
) -> Normalised:
    """Split records (columns of ``record`` plus ``path``) into flat rows with references, and entity mentions.

    References are hashes of entity and name, so neither side waits for the other and
    no join is needed. ``analyzed_at`` gives way to the tables' own time stamps.
    """
    references = reference_fields(record, exact_only)
    stored: list[Column] = []
    for f in record.fields:
        if f.name == "analyzed_at":
            continue
        if f.name in references:
            name = clean_name(F.col(f.name).cast("string"))
            stored.append(F.when(name.isNotNull(), entity_id(F.lit(references[f.name]), name)).alias(f"{f.name}_id"))
        else:
            stored.append(flat_value(F.col(f.name), f.dataType).alias(f.name))
    flat = records.select(F.col(path).alias("path"), *stored)

    simple = {
        f.name: F.col(f.name) for f in record.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    }
    if not references:
        none = F.lit(None).cast("string")
        return Normalised(flat, records.where(F.lit(False)).select(
            F.lit(batch).cast("long").alias("batch"), F.col(path).alias("path"), F.lit(0).alias("pos"),
            none.alias("entity"), none.alias("field"), none.alias("name"),
        ))
    meta = F.col(metadata) if metadata else None
    places = {i: f.name for i, f in enumerate(record.fields) if f.name in references}
    known = {i: harvested(simple, meta, references[name], name) for i, name in places.items()}
    carried = [a for a in ATTRIBUTES if any(a in attributes for attributes in known.values())]
    mentions = (
        records.withColumn("pos", F.explode(F.array(*[F.lit(i) for i in places])))
        .select(
            F.lit(batch).cast("long").alias("batch"), F.col(path).alias("path"), "pos",
            _by_position({i: F.lit(references[name]) for i, name in places.items()}).alias("entity"),
            _by_position({i: F.lit(name) for i, name in places.items()}).alias("field"),
            _by_position({i: clean_name(F.col(name).cast("string")) for i, name in places.items()}).alias("name"),
            *[_by_position({i: known[i][a] for i in places if a in known[i]}).alias(a) for a in carried],
        )
        .where("name is not null")
    )
    return Normalised(flat, mentions)


def _by_position(values: Mapping[int, Column]) -> Column:
    """The value of the mention at hand; the other ones are not worked out."""
    (first, value), *others = values.items()
    chosen = F.when(F.col("pos") == first, value)
    for position, value in others:
        chosen = chosen.when(F.col("pos") == position, value)
    return chosen


def all_mentions(parts: Iterable[Normalised]) -> DataFrame:
    """Mentions of several record types as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.mentions for p in parts])


def entity_tables(mentions: DataFrame) -> DataFrame:
    """All entities in one table, to be written with one folder per entity."""
    return merged_entities(mentions, ORDER)


def write_database(normalised: dict[str, Normalised], entities: DataFrame, target: str, stamp: str) -> int:
    """All tables of a run as one new version of the database in ``target``; the former one stays readable until then.

    A run adds its records beside those of earlier runs; the same stamp again replaces its own. Of the entities it writes
    only those it meets: one that is stored already keeps its attributes and its ``created_at``, and takes on what it lacked.
    """
    store = Snapshots(entities.sparkSession, target)
    tables = store.tables()
    at = F.lit(stamp).cast("timestamp_ntz")
    for type_key, made in normalised.items():
        name = f"records/{type_key}"
        part = store.write(made.records.withColumns({"created_at": at, "updated_at": at}), name, label=stamp)
        tables[name] = with_part(tables.get(name, []), part)
    fresh = store.write(entities.withColumns({"created_at": at, "updated_at": at}), ENTITY_TABLE, "entity", label=stamp)
    tables[ENTITY_TABLE] = store.compacted(
        ENTITY_TABLE, with_part(tables.get(ENTITY_TABLE, []), fresh), lambda rows: merged(rows, ENTITY_KEYS, ("updated_at",)), "entity"
    )
    return store.commit(tables)


def stored_records(spark: SparkSession, target: str, type_key: str, version: int | None = None) -> DataFrame | None:
    """The records of a type over all runs; None before the first one."""
    return Snapshots(spark, target).read(f"records/{type_key}", version)


def stored_entities(spark: SparkSession, target: str, version: int | None = None) -> DataFrame | None:
    """One row per entity and name over all runs; a filter on ``entity`` reads the folders of that entity only."""
    return Snapshots(spark, target).read_merged(ENTITY_TABLE, ENTITY_KEYS, ("updated_at",), version)
