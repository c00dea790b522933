"""Scans of document folders, record folders and text tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions.answers import raw_fields, relaxed, strict_errors
from foliary.functions.text import has_supported_suffix, relative_to
from foliary.operators.requests import content_part
from foliary.operators.summary import or_failure_row
from foliary.schema import trimmed

NO_FILES = "No supported input files found"

# What windows-1252 puts at the code points 0x80-0x9f of iso-8859-1, undefined ones left out.
_LATIN_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_WINDOWS_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def scan_documents(spark: SparkSession, folder: str, recurse: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of supported files, without ``recurse`` only those right in the folder.

    Columns that are not used later, above all ``content``, are never read. Sub-folders are always listed, since a flat
    listing takes names like ``k=v`` for partitions and leaves files out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if not recurse:
        files = files.where(F.size(F.split("path", "/")) == depth_of(spark, folder) + 1)
    return files.where(has_supported_suffix(F.col("path")))


def depth_of(spark: SparkSession, folder: str) -> int:
    """Number of steps in the full path of a folder, as its file system names it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(system.makeQualified(path).toString().split("/"))


def read_documents(spark: SparkSession, folder: str, recurse: bool = False) -> DataFrame:
    """(doc_id, path, text, kind) of supported files: UTF-8 text with undecodable bytes left out, a PDF as base64."""
    part = content_part(F.col("content"))
    return scan_documents(spark, folder, recurse).select(
        F.md5("path").alias("doc_id"), "path", part["text"].alias("text"), part["type"].alias("kind")
    )


def scan_or_failure(spark: SparkSession, folder: str, recurse: bool = False) -> DataFrame:
    """The scan without content, or one failure row for a folder without supported files."""
    found = scan_documents(spark, folder, recurse).select("path", "length")
    return or_failure_row(found, folder, f"{NO_FILES} in {folder}")


def stems_in(spark: SparkSession, target: str, extensions: Sequence[str] = (".pdf", ".json")) -> DataFrame:
    """(folder, base) of the files under ``target`` that have one of the suffixes; a target that is not there has none.

    Names only, contents are never read. A file right in the target has the folder ''.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "folder string, base string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)
    steps = F.slice(F.split("path", "/"), depth_of(spark, target) + 1, 1 << 30)
    named = files.select(F.array_join(F.slice(steps, 1, F.size(steps) - 1), "/").alias("folder"), F.get(steps, F.size(steps) - 1).alias("name"))
    found = [
        named.where(F.endswith("name", F.lit(e))).select("folder", F.expr(f"left(name, length(name) - {len(e)})").alias("base"))
        for e in extensions
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def with_relative_path(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("relative_path", relative_to(F.col("path"), root))


def files_by_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """(file, utf8) of every file, told apart line by line in splittable tasks."""
    return (
        spark.read.text(folder)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    )


def from_windows_1252(c: Column) -> Column:
    """Text that was read as iso-8859-1 but written as windows-1252."""
    return F.translate(c, _LATIN_CONTROLS, _WINDOWS_CHARS)


def read_text_table(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV files with header: UTF-8, and windows-1252 for each file where that fails.

    All files are read once, byte by byte; their encoding is looked up by file and applied to the columns.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("encoding", "iso-8859-1").option("lineSep", "\n")
    )
    read = (reader.schema(schema) if schema is not None else reader).csv(folder)
    kinds = files_by_encoding(spark, folder)
    known = read.select("*", F.col("_metadata.file_path").alias("__file")).join(
        kinds.select(F.col("file").alias("__file"), "utf8"), "__file", "left"
    )

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(F.col("utf8"), F.decode(F.encode(c, "iso-8859-1"), "utf-8")).otherwise(from_windows_1252(c))

    return known.select(*[
        (text(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(utf8_name(f.name))
        for f in read.schema.fields
    ])


def utf8_name(name: str) -> str:
    """A column name from a header that was read byte by byte."""
    try:
        return name.encode("iso-8859-1").decode("utf-8").removeprefix("\ufeff")
    except UnicodeError:
        return name


def plain_path(encoded: Column) -> Column:
    """A path as it is named, from the encoded form of file metadata (where a plus sign stands for itself)."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def read_records(spark: SparkSession, folder: str, recurse: bool = False) -> DataFrame:
    """(path, text) of a folder with one JSON object per file. Sort slim results by path, not the texts."""
    return (
        spark.read.option("wholetext", True).option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", str(recurse).lower()).text(folder)
        .select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    )


def parsed_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """(path, record, errors) by the strict rule; unreadable files stay as rows with errors."""
    wanted = trimmed(schema) if schema else schema
    raw = records.select("path", raw_fields(F.col("text")).alias("raw"))
    read = raw.withColumn("record", relaxed(F.col("raw"), wanted))
    errors = strict_errors(F.col("raw"), F.col("record"), wanted)
    return read.select("path", "record", errors.alias("errors"))


def union_results(results: Mapping[str, DataFrame]) -> DataFrame:
    """Result rows of several inputs as one table with the name of the input."""
    united: DataFrame | None = None
    for name, rows in results.items():
        named = rows.withColumn("input", F.lit(name))
        united = named if united is None else united.unionByName(named, allowMissingColumns=True)
    if united is None:
        raise ValueError("no inputs")
    return united


def document_path(source: Column, doc_id: Column, suffix: Column) -> Column:
    return F.concat(source, F.lit("/doc_"), doc_id.cast("string"), F.lit("."), suffix)
