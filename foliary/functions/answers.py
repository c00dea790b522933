"""Reading a provider's JSON answer: fence, parse, scrub, default, validate.

An answer is parsed once into a map of variants, which keep what the text of a value cannot tell: whether it was text, a
number, a list or an object. Record and errors are both read by walking the schema over those variants, so one bad value
is reported by its path (``lines[1].street: null``) and never loses the other fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions import dates
from foliary.functions.text import blank_to_null, is_blank, strip
from foliary.schema import default_of, enum_of, is_required, parse_of

RAW = "map<string,variant>"
MALFORMED = "answer: malformed"
_BETWEEN = "\x1f"

# How a field may be given besides its plain form; the year after a colon ends the window of two-digit years.
PARSERS = {
    "written_date": lambda c, year: dates.written_date(c),
    "full_date": dates.full_date,
    "month_year": dates.month_year,
    "year_in_text": lambda c, year: dates.year_in_text(c),
}

# Words read as booleans besides what a cast accepts.
TRUE_WORDS, FALSE_WORDS = ("on",), ("off",)


def without_fence(answer: Column) -> Column:
    """Drop a Markdown code fence, only when the trimmed text starts with one."""
    text = strip(answer)
    opened = F.regexp_replace(text, r"\A```[a-zA-Z]*\n?", "")
    inner = strip(F.regexp_replace(opened, r"\n?```\z", ""))
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def raw_fields(text: Column) -> Column:
    """Top-level keys with their values as variants; null unless the text is one whole JSON object.

    Reading the text as the only item of an array also rejects anything after the object.
    """
    whole = strip(text)
    items = F.from_json(F.concat(F.lit("["), whole, F.lit("]")), f"array<{RAW}>", {"allowSingleQuotes": "false"})
    # Going through one-item arrays keeps the parse from being worked out twice.
    single = F.transform(F.filter(F.array(items), lambda i: F.size(i) == 1), lambda i: i[0])
    return F.when(F.endswith(whole, F.lit("}")), F.get(single, 0))


def is_json_object(text: Column) -> Column:
    return raw_fields(text).isNotNull()


def scrubbed(c: Column, data_type: T.DataType) -> Column:
    """Blank text becomes null at every level of a struct, array or map."""
    if isinstance(data_type, T.StringType):
        return blank_to_null(c)
    if isinstance(data_type, T.StructType):
        inner = F.struct(*[scrubbed(c[f.name], f.dataType).alias(f.name) for f in data_type.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: scrubbed(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(c, lambda _, v: scrubbed(v, data_type.valueType))
    return c


def cast_text(c: Column, data_type: T.DataType) -> Column:
    """Raw JSON text as ``data_type``, or null when it does not fit."""
    if isinstance(data_type, T.StringType):
        return c
    if isinstance(data_type, (T.LongType, T.IntegerType)):
        number = c.try_cast("decimal(38,9)")
        return F.when(number == F.floor(number), number.try_cast(data_type))
    if isinstance(data_type, T.BooleanType):
        word = F.lower(c)
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(c.try_cast("boolean"))
    if isinstance(data_type, T.DateType):
        day = c.rlike(r"\A\d{4}-\d{2}-\d{2}([T ]00:00(:00(\.0+)?)?Z?)?\z")
        return F.when(day, F.substring(c, 1, 10).try_cast("date"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}"), c.try_cast(data_type))
    if isinstance(data_type, T.VariantType):
        return F.try_parse_json(c)
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(c, data_type.json() if isinstance(data_type, T.StructType) else data_type.simpleString())
    return c.try_cast(data_type)


def parsed(text: Column, rule: str | None) -> Column:
    """The text with what the field's own parser reads in plain form; what it cannot read stays as it is."""
    if rule is None:
        return text
    name, _, year = rule.partition(":")
    return F.coalesce(PARSERS[name](text, int(year or 0)).cast("string"), text)


def text_of(value: Column) -> Column:
    """A variant as text: a scalar's own, a list or an object as JSON; null for JSON null or nothing."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.when(~F.is_variant_null(value), F.to_json(value)))


def inner(value: Column, name: str) -> Column:
    """A key of a variant object; null only where the key is missing."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def items_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def entries_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda v: make(v)), 0)


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def relaxed_value(value: Column, data_type: T.DataType, rule: str | None = None) -> Column:
    """A variant as ``data_type``, or null where it does not fit; blank text is null at every level."""
    if isinstance(data_type, T.StructType):
        fields = F.struct(*[
            bound(inner(value, f.name), lambda at, f=f: relaxed_field(at, at.isNotNull(), f)).alias(f.name) for f in data_type.fields
        ])
        return F.when(is_object(value), fields)
    if isinstance(data_type, T.ArrayType):
        return F.transform(items_of(value), lambda x: relaxed_value(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        read = F.transform_values(entries_of(value), lambda _, v: relaxed_value(v, data_type.valueType))
        if isinstance(data_type.keyType, T.StringType):
            return read
        return F.transform_keys(read, lambda k, _: cast_text(k, data_type.keyType))
    if isinstance(data_type, T.VariantType):
        return F.when(~F.is_variant_null(value), value)
    if isinstance(data_type, T.StringType):
        return blank_to_null(parsed(text_of(value), rule))
    # Blank text, a list or an object casts to nothing.
    return cast_text(parsed(F.try_variant_get(value, "$", "string"), rule), data_type)


def relaxed_field(value: Column, present: Column, f: T.StructField) -> Column:
    """One field of the relaxed parse, at any depth.

    A missing key takes the declared default; a null or blank value becomes null; a declared parser comes first.
    """
    read = relaxed_value(value, f.dataType, parse_of(f))
    default = default_of(f)
    if default is None:
        return read
    filled = F.lit(default).cast(f.dataType) if not isinstance(default, (list, dict)) else F.from_json(
        F.lit(f.metadata["default"]), f.dataType.simpleString())
    return F.when(present, read).otherwise(filled)


def relaxed(raw: Column, record: T.StructType) -> Column:
    """The whole record; null when the answer could not be read at all."""
    fields = []
    for f in record.fields:
        present = F.map_contains_key(raw, f.name)
        read = bound(raw[f.name], lambda v, f=f, present=present: relaxed_field(v, present, f)) if _is_nested(f.dataType) else (
            relaxed_field(raw[f.name], present, f)
        )
        fields.append(read.alias(f.name))
    return F.when(raw.isNotNull(), F.struct(*fields))


def _said(path: Column, word: str) -> Column:
    return F.concat(path, F.lit(f": {word}"))


def _scalar_problem(kind: Column, value: Column, data_type: T.DataType, allowed: list[str] | None, path: Column) -> Column:
    """``type`` or ``enum`` of a value that came with something, else null. Text is wanted as text; others may come as text."""
    problem = F.when(value.isNull(), _said(path, "type"))
    if isinstance(data_type, T.StringType):
        problem = problem.when(kind != "STRING", _said(path, "type"))
    return problem if allowed is None else problem.when(~value.isin(*allowed), _said(path, "enum"))


def _inside(given: Column, kind: Column, value: Column, data_type: T.DataType, allowed: list[str] | None, path: Column) -> Column:
    """The messages of a value that came with something, as one text; null or empty for none."""
    if isinstance(data_type, T.StructType):
        found = F.concat_ws(_BETWEEN, *[
            _at(inner(given, f.name), value[f.name], lambda g, k, v, f=f: problems(g, k, k.isNotNull(), v, f, F.concat(path, F.lit(f".{f.name}"))))
            for f in data_type.fields
        ])
    elif isinstance(data_type, T.ArrayType):
        def item(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            nothing = F.lit(None).cast("string") if data_type.containsNull else _said(at, "null")
            return _at(x, F.get(value, i), lambda g, k, v: F.when(_blank(g, k), nothing).otherwise(
                _inside(g, k, v, data_type.elementType, allowed, at)))

        found = F.concat_ws(_BETWEEN, F.transform(items_of(given), item))
    elif isinstance(data_type, T.MapType):
        def entry(e: Column) -> Column:
            at = F.concat(path, F.lit("."), e["key"])
            return _at(e["value"], value[cast_text(e["key"], data_type.keyType)], lambda g, k, v: F.when(
                ~_blank(g, k), _inside(g, k, v, data_type.valueType, allowed, at)))

        found = F.concat_ws(_BETWEEN, F.transform(F.map_entries(entries_of(given)), entry))
    else:
        return _scalar_problem(kind, value, data_type, allowed, path)
    return F.when(value.isNull(), _said(path, "type")).otherwise(found)


def _at(given: Column, value: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(given, kind of given, value)`` with each worked out once."""
    return bound(
        F.struct(given.alias("given"), value.alias("value")),
        lambda x: bound(
            F.struct(x["given"].alias("given"), F.schema_of_variant(x["given"]).alias("kind"), x["value"].alias("value")),
            lambda y: make(y["given"], y["kind"], y["value"]),
        ),
    )


def _blank(given: Column, kind: Column) -> Column:
    """JSON null, nothing, or blank text."""
    return kind.isNull() | (kind == "VOID") | ((kind == "STRING") & is_blank(F.try_variant_get(given, "$", "string")))


def _is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType))


def problems(given: Column, kind: Column, present: Column, value: Column, f: T.StructField, path: Column) -> Column:
    """All messages of a field as one text: ``missing``, ``null``, ``type`` or ``enum`` at its own or a deeper path."""
    found = _inside(given, kind, value, f.dataType, enum_of(f), path)
    # A value that was read is not missing, blank or of the wrong type, so nothing else is worked out for it.
    problem = F.when(value.isNotNull(), found)
    if is_required(f) and default_of(f) is None:
        problem = problem.when(~present, _said(path, "missing")).when(_blank(given, kind), _said(path, "null"))
    return problem.when(~_blank(given, kind), _said(path, "type"))


def strict_errors(raw: Column, record: Column, schema: T.StructType, reject_unknown: bool = False) -> Column:
    """All broken rules of a parsed record, in field order and at any depth. Extra keys are ignored unless ``reject_unknown``.

    A list may hold nulls unless its type says otherwise (``ArrayType(..., containsNull=False)``).
    """
    messages = []
    for f in schema.fields:
        given, present, path = raw[f.name], F.map_contains_key(raw, f.name), F.lit(f.name)
        if _is_nested(f.dataType):
            messages.append(_at(given, record[f.name], lambda g, k, v, f=f, p=present, at=path: problems(g, k, p, v, f, at)))
        else:
            # Stays inside generated code.
            messages.append(problems(given, F.schema_of_variant(given), present, record[f.name], f, path))
    if reject_unknown:
        messages.append(F.transform(unknown_keys(raw, schema), lambda k: _said(k, "unknown")))
    # Joined and split again: unlike a filter over an array this stays inside generated code.
    broken = F.array_remove(F.split(F.concat_ws(_BETWEEN, *messages), _BETWEEN), "")
    return F.when(raw.isNull(), F.array(F.lit(MALFORMED))).otherwise(broken)


def unknown_keys(raw: Column, schema: T.StructType) -> Column:
    return F.array_sort(F.array_except(F.map_keys(raw), _names(schema)))


def missing_keys(raw: Column, schema: T.StructType) -> Column:
    return F.array_sort(F.array_except(_names(schema), F.map_keys(raw)))


def empty_keys(raw: Column, schema: T.StructType) -> Column:
    """Expected keys that came with null, blank text or an empty list or object."""
    came = F.array_intersect(_names(schema), F.map_keys(raw))

    def empty(key: Column) -> Column:
        return _blank(raw[key], F.schema_of_variant(raw[key])) | F.to_json(raw[key]).isin("[]", "{}")

    return F.array_sort(F.filter(came, empty))


def _names(schema: T.StructType) -> Column:
    return F.array(*[F.lit(n) for n in schema.fieldNames()])
