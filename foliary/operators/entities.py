"""Shared entities: which fields name one, what is known about it, and who refers to it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import schema as S
from foliary.functions.text import blank_to_null, is_blank, strip
from foliary.operators.skew import ordinal, skew_join

# Entities in order of precedence, with the field names that identify them.
ENTITIES = {
    "DocumentClassification": ("model_name",),
    "Customer": ("name", "customer_name", "client_name", "client", "licensee", "counterparty"),
    "Employee": ("employee_name", "staff_name", "personnel_name", "employee"),
    "Company": ("company_name", "organization_name", "org_name", "corporate_name", "employer", "licensor", "company"),
    "Product": ("product_name", "item_name", "service_name", "product", "service_covered"),
    "Contract": ("contract_id", "agreement_id", "document_id"),
    "Jurisdiction": ("governing_law", "governing_law_jurisdiction", "jurisdiction"),
    "Vendor": ("vendor", "supplier", "provider", "service_provider"),
    "Location": ("location", "office_location", "address", "site", "locations"),
    "Department": ("department", "division", "business_unit", "team"),
    "Position": ("position", "job_title", "title", "role"),
    "Document": ("document", "file", "document_id", "file_path"),
    "PaymentTerm": ("payment_term", "payment_terms", "payment_frequency"),
    "Industry": ("industry", "sector", "business_sector", "market_segment"),
    "Currency": ("currency", "currency_code"),
    "BankAccount": ("bank_account", "account_number", "banking_details"),
    "TaxAuthority": ("tax_authority", "tax_jurisdiction", "taxing_entity"),
}
# Shorter identifiers count only as a whole name or at one end, next to an underscore.
LONG_IDENTIFIER = 5

# Metadata keys, then field names, that fill an attribute; "{field}" is the referring field.
METADATA_KEYS = {
    "Company": {
        "website": ("company_website", "website"),
        "industry": ("industry", "sector"),
        "description": ("company_description", "description"),
    },
    "Customer": {
        "contact_email": ("customer_email", "contact_email"),
        "contact_phone": ("customer_phone", "contact_phone"),
        "description": ("customer_description", "description"),
    },
    "Product": {
        "version": ("product_version", "version"),
        "product_type": ("product_type", "type"),
        "description": ("product_description", "description"),
    },
}
FIELD_KEYS = {
    "Company": {
        "website": ("{field}_website", "company_website", "website", "url"),
        "industry": ("{field}_industry", "company_industry", "industry", "sector", "field"),
    },
    "Customer": {
        "contact_email": ("{field}_email", "customer_email", "client_email", "contact_email", "email"),
        "contact_phone": ("{field}_phone", "customer_phone", "client_phone", "contact_phone", "phone"),
    },
    "Contract": {
        "effective_date": ("effective_date", "start_date", "execution_date", "agreement_date"),
        "expiration_date": ("expiration_date", "end_date", "termination_date"),
        "contract_type": ("contract_type", "agreement_type", "document_type"),
    },
}
ATTRIBUTES = (
    "contact_email", "contact_phone", "website", "industry", "version", "product_type",
    "effective_date", "expiration_date", "contract_type", "description",
)


def entity_id(entity: Column, name: Column) -> Column:
    """A stable id that any task can compute from the row alone: no lookup join, no counter."""
    return F.md5(F.concat_ws("||", entity, name))


def clean_name(value: Column) -> Column:
    return blank_to_null(strip(value))


# -- which field names which entity ------------------------------------------


def field_matches(name: Column, identifier: Column, exact_only: bool = False) -> Column:
    if exact_only:
        return name == identifier
    at_end = F.startswith(name, F.concat(identifier, F.lit("_"))) | F.endswith(name, F.concat(F.lit("_"), identifier))
    inside = F.contains(name, identifier) & ((F.length(identifier) >= LONG_IDENTIFIER) | at_end)
    return (name == identifier) | inside


def tagged_fields(fields: DataFrame, exact_only: bool = False) -> DataFrame:
    """(type_key, field, pos) -> + entity. Several entities may match a field; the one that
    is met first while walking the fields of the type wins, then the earlier entity.
    """
    known = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(e).alias("entity"), F.array(*[F.lit(x) for x in ids]).alias("ids"))
        for i, (e, ids) in enumerate(ENTITIES.items())
    ])
    matching = F.filter(
        known, lambda e: F.exists(e["ids"], lambda i: field_matches(F.col("field"), i, exact_only))
    )
    return (
        fields.select("type_key", "field", "pos", F.explode(matching).alias("m"))
        .withColumn("seen", F.min("pos").over(Window.partitionBy("type_key", "m.ord")))
        .groupBy("type_key", "field")
        .agg(F.min(F.struct("seen", "m.ord", "m.entity")).alias("best"))
        .select("type_key", "field", F.col("best.entity").alias("entity"))
    )


def tagged_facts(facts: DataFrame, spread: Sequence[str], exact_only: bool = False) -> DataFrame:
    """(type_key, field, pos, value, ...) -> + entity and trimmed name.

    The rule runs on the distinct fields; few fields own many facts, so the way
    back splits them.
    """
    fields = facts.groupBy("type_key", "field").agg(F.min("pos").alias("pos"))
    return skew_join(
        facts, tagged_fields(fields, exact_only), ["type_key", "field"], "inner", spread=spread
    ).withColumn("name", clean_name(F.col("value")))


def entity_fields(record: T.StructType, exact_only: bool = False) -> dict[str, str]:
    """field -> entity for a known record type: the same rule over its declared fields (driver side).

    Lists, maps, nested values and enums never name an entity.
    """

    def fits(name: str, identifier: str) -> bool:
        if name == identifier:
            return True
        if exact_only or identifier not in name:
            return False
        at_end = name.startswith(identifier + "_") or name.endswith("_" + identifier)
        return len(identifier) >= LONG_IDENTIFIER or at_end

    matches: dict[str, list[str]] = {}
    seen: list[str] = []
    for f in record.fields:
        simple = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        if not simple or S.enum_of(f) is not None or f.name == "analyzed_at":
            continue
        matches[f.name] = [e for e, ids in ENTITIES.items() if any(fits(f.name, i) for i in ids)]
        seen += [e for e in matches[f.name] if e not in seen]
    return {f: min(found, key=seen.index) for f, found in matches.items() if found}


def reference_fields(record: T.StructType, exact_only: bool = False) -> dict[str, str]:
    """The entity fields that become references: text and dates; flags and numbers stay plain columns."""
    return {
        f: e for f, e in entity_fields(record, exact_only).items()
        if isinstance(record[f].dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    }


# -- what is known about an entity --------------------------------------------


Lookup = Column | Mapping[str, Column]


def _first_filled(data: Lookup, keys: Iterable[str]) -> Column | None:
    """The first value that is not empty; of a typed record only the fields it has."""
    if isinstance(data, Column):
        found = [data[k] for k in keys]
    else:
        found = [data[k].cast("string") for k in keys if k in data]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found]) if found else None


def harvested(data: Lookup, metadata: Column | None, entity: str, field: str) -> dict[str, Column]:
    """Attributes of the entity that ``field`` names, from a record: a map<string,string> column,
    or the columns of a typed record by field name. Attributes that cannot be filled are left out.

    A filled record field goes before metadata; the record's own description counts
    only when the record has no metadata that could have carried one.
    """
    found: dict[str, Column | None] = {}
    has_metadata = F.lit(False) if metadata is None else F.coalesce(F.size(metadata) > 0, F.lit(False))
    if metadata is not None:
        for attribute, keys in METADATA_KEYS.get(entity, {}).items():
            found[attribute] = F.when(has_metadata, _first_filled(metadata, keys))
    for attribute, keys in FIELD_KEYS.get(entity, {}).items():
        own = _first_filled(data, [k.format(field=field) for k in keys])
        if own is not None:
            found[attribute] = F.coalesce(own, found[attribute]) if attribute in found else own
    description = _first_filled(data, ["description"])
    if "description" in found:
        own = F.lit(None).cast("string") if description is None else description
        found["description"] = F.when(has_metadata, found["description"]).otherwise(own)
    else:
        found["description"] = description
    return {k: v for k, v in found.items() if v is not None}


def merged_entities(mentions: DataFrame, order: Sequence[str], attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """One row per (entity, name): the first non-blank value of each attribute by ``order``.

    Aggregates before the shuffle, so a name that fills a third of all rows stays cheap.
    Attributes that no mention carries are null.
    """
    seq = F.struct(*order)
    carried = [a for a in attributes if a in mentions.columns]
    first = [F.min_by(a, F.when(~is_blank(F.col(a)), seq)).alias(a) for a in carried]
    merged = mentions.where("name is not null").groupBy("entity", "name").agg(F.min(seq).alias("first_seen"), *first)
    empty = F.lit(None).cast("string")
    return merged.select(
        "entity", "name", "first_seen", *[F.col(a) if a in carried else empty.alias(a) for a in attributes],
        entity_id(F.col("entity"), F.col("name")).alias("entity_id"),
    )


def upserted(old: DataFrame, mentions: DataFrame, order: Sequence[str], attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Old entities take part as mentions of their first sighting, so they keep what they know."""
    before = old.select("entity", "name", *[F.col(f"first_seen.{o}").alias(o) for o in order], *attributes)
    new = mentions.select(*[c for c in before.columns if c in mentions.columns])
    return merged_entities(before.unionByName(new, allowMissingColumns=True), order, attributes)


def dense_ids(entities: DataFrame) -> DataFrame:
    """Running integer ids per entity by first sighting, then name."""
    return ordinal(entities, ["entity"], ["first_seen", "name"], "id")


# -- references ---------------------------------------------------------------


def with_references(rows: DataFrame, entities: DataFrame, entity: str, value: str, spread: Sequence[str],
                    out: str = "entity_id") -> DataFrame:
    """Look an entity up by trimmed name (needed only for ids that are not a hash of the name)."""
    known = entities.where(F.col("entity") == entity).select(F.col("name").alias("__name"), F.col(out))
    named = rows.withColumn("__name", clean_name(F.col(value)))
    return skew_join(named, known, ["__name"], "left", spread=spread).drop("__name")


def references_to(records: DataFrame, entity_key: str, record_key: str) -> DataFrame:
    """The reverse side of a reference: how many records point at each entity, and which come first and last."""
    return records.groupBy(entity_key).agg(
        F.count(F.lit(1)).alias("records"), F.min(record_key).alias("first_record"),
        F.max(record_key).alias("last_record"),
    )


def record_entities(records: DataFrame, entities: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Every record with the row of the entity it points at, or nulls. ``entities`` is unique on ``key``."""
    return skew_join(records, entities, [key], "left", spread=spread)


def members(records: DataFrame, entity_key: str, order: Sequence[str]) -> DataFrame:
    """The records of every entity as rows with their position from 1; a large entity spans many tasks."""
    return ordinal(records.where(F.col(entity_key).isNotNull()), [entity_key], order, "position")


def usage(facts: DataFrame) -> DataFrame:
    """Per entity, which record type and field refer to it, how often and with how many names."""
    named = facts.where("name is not null").groupBy("entity", "type_key", "field", "name").agg(
        F.count(F.lit(1)).alias("n")
    )
    return named.groupBy("entity", "type_key", "field").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("names")
    )


def kept_after_delete(records: DataFrame, deleted: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Records whose entity was not deleted; records without one are orphans and go as well."""
    gone = deleted.select(key).distinct()
    return skew_join(records.where(F.col(key).isNotNull()), gone, [key], "left_anti", spread=spread)


def removed_by_delete(records: DataFrame, deleted: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    gone = deleted.select(key).distinct()
    return skew_join(records.where(F.col(key).isNotNull()), gone, [key], "left_semi", spread=spread)


# -- storage form -------------------------------------------------------------


def flat_value(c: Column, data_type: T.DataType) -> Column:
    """Nested values as JSON text, everything else as it is."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c)
    return c


def as_text_map(columns: Mapping[str, Column]) -> Column:
    """A record as map<string,string> of the given columns."""
    entries: list[Column] = []
    for name, c in columns.items():
        entries += [F.lit(name), c.cast("string")]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
