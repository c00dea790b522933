"""Records as Markdown or HTML text. The driver walks the schema and emits native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions.dates import iso_text

# Fixed values of the rendered documents.
STYLESHEET = "https://cdn.jsdelivr.net/npm/github-markdown-css@5.2.0/github-markdown.min.css"
SOURCE_LABEL = "Source PDF"
INDEX_TITLE = "Documents"
NULL_TEXT, TRUE_TEXT, FALSE_TEXT = "None", "True", "False"
HTML_OPEN = "<!doctype html><html><head><meta charset='utf-8'>"
HTML_STYLE = f'<link rel="stylesheet" href="{STYLESHEET}">'
HTML_BODY = '</title></head><body class="markdown-body">'
HTML_CLOSE = "</body></html>"


def label(name: str) -> str:
    return name.replace("_", " ").title()


def escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def plain_number(c: Column) -> Column:
    """A double with its shortest digits, without an exponent up to 1e16."""
    text = c.cast("string")
    wide = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+\z", "$1")
    size = F.abs(c)
    return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), wide).otherwise(text)


def scalar_text(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        text = F.when(c, TRUE_TEXT).when(~c, FALSE_TEXT)
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = plain_number(c.cast("double"))
    elif isinstance(data_type, T.DateType):
        text = iso_text(c, False)
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        text = F.replace(iso_text(c, True), F.lit("T"), F.lit(" "))
    elif isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))


def key_label(key: Column) -> Column:
    """The label of a map key, by the rule of ``label``: every run of cased letters starts with a capital."""
    runs = F.regexp_extract_all(F.replace(key, F.lit("_"), F.lit(" ")), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def markdown(c: Column, data_type: T.DataType, indent: int = 0) -> Column:
    pad = " " * indent
    if isinstance(data_type, T.StructType):
        lines: list[Column] = []
        for f in data_type.fields:
            lines += [F.lit(f"{pad}- **{label(f.name)}:**"), markdown(c[f.name], f.dataType, indent + 2)]
        body = F.concat_ws("\n", *lines)
    elif isinstance(data_type, T.MapType):
        body = F.array_join(
            F.transform(
                F.map_entries(c),
                lambda e: F.concat(
                    F.lit(f"{pad}- **"), key_label(e["key"]), F.lit(":**\n"),
                    markdown(e["value"], data_type.valueType, indent + 2),
                ),
            ),
            "\n",
        )
    elif isinstance(data_type, T.ArrayType):
        body = F.array_join(
            F.transform(c, lambda x: F.concat(F.lit(f"{pad}- "), scalar_text(x, data_type.elementType))), "\n"
        )
    else:
        return F.concat(F.lit(pad), scalar_text(c, data_type))
    return F.when(c.isNotNull(), body).otherwise(F.lit(pad + NULL_TEXT))


def html(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StructType):
        items: list[Column] = []
        for f in data_type.fields:
            items += [F.lit(f"<li><strong>{label(f.name)}:</strong>"), html(c[f.name], f.dataType), F.lit("</li>")]
        body = F.concat(F.lit("<ul>"), *items, F.lit("</ul>"))
    elif isinstance(data_type, T.MapType):
        rows = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                F.lit("<li><strong>"), escaped(key_label(e["key"])),
                F.lit(":</strong>"), html(e["value"], data_type.valueType), F.lit("</li>"),
            ),
        )
        body = F.concat(F.lit("<ul>"), F.array_join(rows, ""), F.lit("</ul>"))
    elif isinstance(data_type, T.ArrayType):
        rows = F.transform(c, lambda x: F.concat(F.lit("<li>"), html(x, data_type.elementType), F.lit("</li>")))
        body = F.concat(F.lit("<ul>"), F.array_join(rows, ""), F.lit("</ul>"))
    else:
        return F.concat(F.lit(" "), escaped(scalar_text(c, data_type)))
    return F.when(c.isNotNull(), body).otherwise(F.lit(" " + NULL_TEXT))


def markdown_document(record: Column, schema: T.StructType, title: Column, source: Column | None = None) -> Column:
    link = F.lit("")
    if source is not None:
        has = source.isNotNull() & (source != "")
        link = F.when(has, F.concat(F.lit(f"[{SOURCE_LABEL}]("), source, F.lit(")\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), link, markdown(record, schema))


def html_page(title: Column, body: Column) -> Column:
    """A whole page; ``title`` and ``body`` are escaped already."""
    return F.concat(F.lit(HTML_OPEN + HTML_STYLE + "<title>"), title, F.lit(HTML_BODY), body, F.lit(HTML_CLOSE))


def html_document(record: Column, schema: T.StructType, title: Column, source: Column | None = None) -> Column:
    link = F.lit("")
    if source is not None:
        has = source.isNotNull() & (source != "")
        link = F.when(has, F.concat(F.lit('<p><a href="'), escaped(source), F.lit(f'">{SOURCE_LABEL}</a></p>'))).otherwise(
            F.lit("")
        )
    name = escaped(title)
    return html_page(name, F.concat(F.lit("<h1>"), name, F.lit("</h1>"), link, html(record, schema)))
