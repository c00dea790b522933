"""Registration of queries with the SQL that must give the same rows, and shared derivations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.sources.files import document_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SUFFIXES = ("pdf", "TXT", "text", "md", "rtf", "docx")
DOC_TYPES = (
    "financial_statement", "employment_contract", "patent", "tax_return", "customer_contract", "software_license",
    "service_level_agreement", "corporate_bylaws", "privacy_policy", "security_audit", "memo", "letter",
)
SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(number: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def pick_sql(number: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {cases} END"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """documents with a file path."""
    return table(spark, folder, "documents").withColumn(
        "path", document_path(F.col("source"), F.col("doc_id"), pick(F.col("doc_id"), SUFFIXES))
    )


DOCS = f"(SELECT *, source || '/doc_' || doc_id || '.' || {pick_sql('doc_id', SUFFIXES)} AS path FROM documents)"


def strip_sql(expr: str) -> str:
    return rf"regexp_replace({expr}, '\A{SPACE_SQL}+|{SPACE_SQL}+\z', '', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
