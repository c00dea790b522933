"""Requests: text, message parts, option defaults, routing and keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import schema
from foliary.functions.text import decoded, is_pdf, parts_key
from foliary.operators.skew import ordinal, skew_join
from foliary.session import staged

# Fixed values.
PROVIDERS = {"anthropic": "anthropic", "claude": "anthropic", "openai": "openai"}
DEFAULT_MODELS = {"anthropic": "claude-sonnet-4-20250514", "openai": "gpt-4.1"}
REASONING_MODELS = ("o4-mini", "o3", "o1", "o1-pro")
DEFAULT_MAX_TOKENS = 2048
TABLE_MAX_TOKENS = 2000

PART = "struct<type:string,text:string>"


def instruction(record: T.StructType) -> str:
    """What the provider is asked to do, built once per record type on the driver."""
    shown = json.dumps(schema.describe(record), indent=2)
    return f"Read the document and answer with one JSON object of this schema, leaving out what is not stated:\n{shown}"


def request_text(prompt: str | Column, body: Column) -> Column:
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    return F.concat(prompt, F.lit("\n"), body)


def text_part(c: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), c.alias("text"))


def with_extra(parts: Column, extra: Column) -> Column:
    """Append one more text part to the array when there is an extra instruction."""
    given = extra.isNotNull() & (extra != "")
    return F.concat(parts, F.when(given, F.array(text_part(extra))).otherwise(F.array().cast(f"array<{PART}>")))


def content_part(content: Column) -> Column:
    """Bytes as a message part: a PDF as base64 document, anything else as UTF-8 text."""
    pdf = is_pdf(content)
    return F.struct(
        F.when(pdf, F.lit("document")).otherwise(F.lit("text")).alias("type"),
        F.when(pdf, F.regexp_replace(F.base64(content), r"\s", "")).otherwise(decoded(content)).alias("text"),
    )


def routed(provider: Column) -> tuple[Column, Column]:
    """(canonical provider, error): exactly one of the two is null."""
    known = F.lower(provider)
    route = None
    for name, target in PROVIDERS.items():
        route = F.when(known == name, target) if route is None else route.when(known == name, target)
    error = F.concat(F.lit("Unknown provider '"), F.coalesce(known, F.lit("")), F.lit("'"))
    return route, F.when(route.isNull(), error)


def unknown_provider(name: str) -> str | None:
    """The error of a job whose provider is not known."""
    return None if name.lower() in PROVIDERS else f"Unknown provider '{name.lower()}'"


def with_option_defaults(requests: DataFrame) -> DataFrame:
    """Fill provider, model, small_model, temperature and max_tokens of each request row."""
    provider = F.lower(F.coalesce("provider", F.lit("anthropic")))
    default_model = F.when(provider == "openai", DEFAULT_MODELS["openai"]).otherwise(DEFAULT_MODELS["anthropic"])
    model = F.coalesce("model", default_model)
    fixed_one = (provider == "openai") & model.isin(*REASONING_MODELS)
    return requests.withColumns(
        {
            "provider": provider,
            "model": model,
            "small_model": F.coalesce("small_model", model),
            "temperature": F.when(fixed_one, F.lit(1.0)).otherwise(F.coalesce("temperature", F.lit(0.0))),
            "max_tokens": F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS)),
        }
    )


def request_key(
    provider: Column, model: Column, system: Column, content: Column, max_tokens: Column, type_key: Column
) -> Column:
    """md5 over everything that decides an answer. ``content`` should be a content hash."""
    return parts_key(
        F.concat_ws(":", provider, F.coalesce(model, F.lit(""))), system, content, max_tokens,
        F.coalesce(type_key, F.lit("none")),
    )


def part_requests(docs: DataFrame, n_parts: int) -> DataFrame:
    """One row per document and schema part, ``part`` counting from 1."""
    return docs.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(n_parts))))


def message_pieces(
    items: DataFrame, owner: str, position: str, kind: str, text: str, items_per_piece: int = 1024
) -> DataFrame:
    """Message lists as typed parts in pieces of bounded length: (owner, seq, type, piece, text).

    The parts are those of ``normalised_messages``. A part of more than ``items_per_piece`` items comes in several rows with
    ``piece`` counting from 0; their texts, joined by newlines in that order, are its text. So no list, however long,
    meets one task or one value. A null text adds nothing, not even a newline. A null owner is an owner like others.
    """
    numbered = ordinal(_parts(items, owner, position, kind, text), [owner, "seq", "type"], ["__at", "__text"], "__n", start=0)
    piece = F.floor(F.col("__n") / items_per_piece).cast("long").alias("piece")
    return (
        numbered.groupBy(owner, "seq", "type", piece)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__text").alias("text")))).alias("items"))
        .select(owner, "seq", "type", "piece", F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"))
    )


def normalised_messages(items: DataFrame, owner: str, position: str, kind: str, text: str) -> DataFrame:
    """Message lists as typed parts: (owner, seq, type, text).

    A list of plain strings becomes one part of newline-joined text, of any length: it is the text of one request.
    A list with any other kind keeps its items apart. Items at the same position stand in the order of their texts.
    """
    return (
        _parts(items, owner, position, kind, text)
        .groupBy(owner, "seq", "type")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__text").alias("text")))).alias("items"))
        .select(owner, "seq", "type", F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"))
    )


def _parts(items: DataFrame, owner: str, position: str, kind: str, text: str) -> DataFrame:
    """Every item with the part it belongs to: (owner, seq, type, __at, __text)."""
    mixed = (
        items.groupBy(owner)
        .agg(F.bool_or(F.col(kind) != "string").alias("mixed"))
        .where("mixed")
        .select(owner, "mixed")
    )
    marked = skew_join(items, mixed, [owner], "left", spread=[owner, position])
    # Whole lists and single items share one grouping: an item alone is its own part.
    segment = F.when(F.col("mixed"), F.col(position)).otherwise(0)
    part_type = F.when(F.col("mixed") & (F.col(kind) != "string"), F.col(kind)).otherwise("text")
    return marked.select(
        owner, segment.cast("long").alias("seq"), part_type.alias("type"), F.col(position).alias("__at"), F.col(text).alias("__text")
    )


def uploads(files: DataFrame, file_id: str, content: str) -> DataFrame:
    """One upload per distinct content: each file with its content hash, reference and uploader.

    The reference is a function of the hash, so no join is needed to hand it out;
    the join back only tells which file stands for the content.
    """
    hashed = staged(files.select(file_id, F.sha2(content, 256).alias("digest")), "digests")
    first = hashed.groupBy("digest").agg(F.min(file_id).alias("uploaded_as"), F.count(F.lit(1)).alias("copies"))
    return skew_join(hashed, first, ["digest"], "left", spread=[file_id]).withColumn(
        "file_ref", F.concat(F.lit("file-"), "digest")
    )


