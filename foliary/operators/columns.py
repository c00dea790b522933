"""Small column steps of the table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.schema import LINEAGE_FIELDS


def passed_through(source: Column, processed: Column) -> Column:
    """Rows without text are kept, with an empty output."""
    return F.when(source.isNull() | (source == ""), F.lit("")).otherwise(processed)


def with_output_columns(table: DataFrame, fields: Sequence[str], prefix: str = "") -> DataFrame:
    """All output columns at once, empty."""
    return table.select("*", *[F.lit("").alias(prefix + f) for f in fields])


def without_lineage(records: DataFrame) -> DataFrame:
    return records.drop(*LINEAGE_FIELDS)


def with_lineage_columns(records: DataFrame, path: Column, analyzed_at: str, model: str | None) -> DataFrame:
    return records.withColumns(
        {
            "source_filename": path,
            "analyzed_at": F.lit(analyzed_at).cast("timestamp_ntz"),
            "llm_model": F.lit(model).cast("string"),
        }
    )
