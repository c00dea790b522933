"""Run summaries, coverage, limits and failure rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The due-diligence areas, and the areas a document type counts for.
AREAS = (
    "business", "financial", "accounting", "tax", "technical", "legal", "operational", "commercial", "regulatory",
    "human_resources", "information_technology", "intellectual_property", "environmental", "insurance", "real_estate",
)
DOCUMENT_AREAS = {
    "financial_statement": ("financial", "accounting"),
    "employment_contract": ("legal", "human_resources"),
    "patent": ("legal", "intellectual_property"),
    "tax_return": ("tax",),
    "customer_contract": ("commercial", "legal"),
    "software_license": ("legal", "information_technology"),
    "service_level_agreement": ("technical", "commercial"),
    "corporate_bylaws": ("legal",),
    "privacy_policy": ("legal", "regulatory"),
    "security_audit": ("information_technology", "technical"),
}

OK, FAILED, NO_RESULT = "ok", "failed", "no_result"


def run_summary(
    results: DataFrame, by: Sequence[str] = (), count_no_result_as_success: bool = True, more: Sequence[Column] = ()
) -> DataFrame:
    """total, success and failure counts; documents without a result count as success unless told otherwise.

    ``more`` aggregates ride along in the same pass.
    """
    good = [OK, NO_RESULT] if count_no_result_as_success else [OK]
    ok = F.col("status").isin(*good)
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"),
        *more,
    )


def failure_summary(results: DataFrame) -> DataFrame:
    """Failures by class, with one message (the least) as a specimen."""
    return (
        results.where(F.col("status") == FAILED)
        .groupBy("error_class")
        .agg(F.count(F.lit(1)).alias("n"), F.min("error_message").alias("error_message"))
    )


def or_failure_row(files: DataFrame, source: str, message: str) -> DataFrame:
    """The files, or a single failure row when there is none."""
    found = files.withColumns({"status": F.lit(OK), "error_message": F.lit(None).cast("string")})
    columns = {
        "path": F.lit(source), "status": F.lit(FAILED), "error_message": F.lit(message),
    }
    none = (
        files.agg(F.count(F.lit(1)).alias("n"))
        .where("n = 0")
        .select(*[columns.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in found.schema.fields])
    )
    return found.unionByName(none)


def crawl_limit(files: DataFrame, limit: int | None, path: str = "path") -> DataFrame:
    """The first ``limit`` files by path; none or a limit below one keeps all."""
    return files.orderBy(path).limit(limit) if limit and limit > 0 else files


def document_areas(mapping: Mapping[str, Sequence[str]] = DOCUMENT_AREAS) -> Column:
    """The mapping as a literal map column."""
    entries = []
    for name, areas in mapping.items():
        entries += [F.lit(name), F.array(*[F.lit(a) for a in areas])]
    return F.create_map(*entries)


def with_area(docs: DataFrame, type_column: str, mapping: Mapping[str, Sequence[str]] = DOCUMENT_AREAS) -> DataFrame:
    """One row per document and area of its type; documents of an unmapped type drop out.

    The mapping is a fixed small constant, so this stays a projection: no join.
    """
    areas = F.element_at(document_areas(mapping), F.col(type_column))
    return docs.withColumn("area", F.explode(F.coalesce(areas, F.array().cast("array<string>"))))


def area_coverage(
    docs: DataFrame, type_column: str, mapping: Mapping[str, Sequence[str]] = DOCUMENT_AREAS,
    areas: Sequence[str] = AREAS,
) -> DataFrame:
    """Documents and document types per area, areas without documents included.

    Documents are counted per type first, so what meets the areas has one row per type.
    """
    per_type = docs.groupBy(type_column).agg(F.count(F.lit(1)).alias("n"))
    per_area = with_area(per_type, type_column, mapping)
    every = docs.sparkSession.createDataFrame([(i, a) for i, a in enumerate(areas)], "position int, area string")
    return (
        every.join(per_area, "area", "left")
        .groupBy("area", "position")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
            F.array_join(F.array_sort(F.collect_set(type_column)), ", ").alias("document_types"),
        )
        .drop("position")
    )


def rendered_summary(records: DataFrame, parsed: Column) -> DataFrame:
    return records.agg(F.count_if(parsed).alias("documents"), F.count_if(~parsed).alias("errors"))


def longest_path(paths: DataFrame, path: str) -> DataFrame:
    return paths.agg(F.coalesce(F.max(F.size(path)), F.lit(0)).cast("long").alias("longest"))
