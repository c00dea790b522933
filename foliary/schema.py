"""Record types are plain ``StructType``s; rules about a field sit in its metadata."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T

# Columns the job fills in itself and never asks a provider for.
LINEAGE_FIELDS = ("source_filename", "analyzed_at", "llm_model")

_NAMES = {
    T.StringType: "string",
    T.LongType: "integer",
    T.IntegerType: "integer",
    T.DoubleType: "number",
    T.FloatType: "number",
    T.BooleanType: "boolean",
    T.DateType: "string(date)",
    T.TimestampType: "string(date-time)",
    T.TimestampNTZType: "string(date-time)",
    T.VariantType: "Any",
}


_SIMPLE = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "variant": T.VariantType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def field(
    name: str,
    data_type: T.DataType | str = "string",
    *,
    required: bool = False,
    default: Any = None,
    enum: tuple[str, ...] | None = None,
    description: str | None = None,
    parse: str | None = None,
) -> T.StructField:
    """``parse`` names how a value that was not given in ISO form is read before validation (see ``answers.PARSERS``)."""
    if isinstance(data_type, str):
        data_type = _SIMPLE.get(data_type) or T.DataType.fromDDL(data_type)
    meta: dict[str, Any] = {"required": required}
    if default is not None:
        meta["default"] = json.dumps(default)
    if enum is not None:
        meta["enum"] = list(enum)
    if description is not None:
        meta["description"] = description
    if parse is not None:
        meta["parse"] = parse
    return T.StructField(name, data_type, True, meta)


def is_required(f: T.StructField) -> bool:
    return bool(f.metadata.get("required"))


def default_of(f: T.StructField) -> Any:
    return json.loads(f.metadata["default"]) if "default" in f.metadata else None


def enum_of(f: T.StructField) -> list[str] | None:
    return f.metadata.get("enum")


def parse_of(f: T.StructField) -> str | None:
    return f.metadata.get("parse")


def with_lineage(record: T.StructType) -> T.StructType:
    extra = [field("source_filename"), field("analyzed_at", "timestamp_ntz"), field("llm_model")]
    return T.StructType([*trimmed(record).fields, *extra])


def trimmed(record: T.StructType) -> T.StructType:
    """The record type without lineage fields."""
    return T.StructType([f for f in record.fields if f.name not in LINEAGE_FIELDS])


def subset(record: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([record[n] for n in names])


def parts(record: T.StructType, size: int) -> list[T.StructType]:
    """The requested fields in runs of ``size``: ceil(n / size) sub-schemas."""
    if size < 1:
        raise ValueError("part size must be positive")
    fields = trimmed(record).fields
    return [T.StructType(fields[i : i + size]) for i in range(0, len(fields), size)]


def type_text(data_type: T.DataType, enum: list[str] | None = None) -> str:
    if enum is not None:
        return "enum[" + ", ".join(repr(v) for v in enum) + "]"
    if isinstance(data_type, T.ArrayType):
        return f"array<{type_text(data_type.elementType)}>"
    if isinstance(data_type, T.MapType):
        return f"object<{type_text(data_type.keyType)}, {type_text(data_type.valueType)}>"
    if isinstance(data_type, T.StructType):
        return "object"
    return _NAMES.get(type(data_type), data_type.simpleString())


def describe(record: T.StructType) -> dict[str, dict[str, Any]]:
    """The schema as it is shown to a provider."""
    shown = {}
    for f in trimmed(record).fields:
        shown[f.name] = {"type": type_text(f.dataType, enum_of(f)), "required": is_required(f)}
        if f.metadata.get("description"):
            shown[f.name]["description"] = f.metadata["description"]
    return shown
