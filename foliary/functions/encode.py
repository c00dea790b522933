"""Records and values as text for files and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions.dates import iso_text
from foliary.functions.render import plain_number

TYPE_TAG = "record_type"


def tagged_json(type_key: Column, record: Column, schema: T.StructType, tag: str = TYPE_TAG) -> Column:
    """One JSON object: the type tag first, then every field, nulls included, dates and times in ISO form."""
    fields = [with_iso_texts(record[f.name], f.dataType).alias(f.name) for f in schema.fields]
    return F.to_json(F.struct(type_key.alias(tag), *fields), {"ignoreNullFields": "false"})


def has_dates(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(has_dates(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return has_dates(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return has_dates(data_type.valueType)
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def with_iso_texts(c: Column, data_type: T.DataType) -> Column:
    """The value with every date and time at any depth as ISO text, fractions of seconds included."""
    if not has_dates(data_type):
        return c
    if isinstance(data_type, T.StructType):
        inner = F.struct(*[with_iso_texts(c[f.name], f.dataType).alias(f.name) for f in data_type.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: with_iso_texts(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(c, lambda _, v: with_iso_texts(v, data_type.valueType))
    return iso_text(c, not isinstance(data_type, T.DateType))


def cell(c: Column, data_type: T.DataType) -> Column:
    """A table cell: nested values as JSON, numbers without an exponent, others as plain text, null as empty text."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        text = F.to_json(with_iso_texts(c, data_type))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = plain_number(c.cast("double"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))
