"""What the plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.catalog import registry
from foliary.operators import classify, entities
from foliary.operators.cache import empty_cache
from foliary.operators.providers import RuleProvider
from foliary.plans.extraction import Job, extract
from foliary.plans.normalise import normalise
from foliary.schema import field

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCUMENTS).withColumn("path", F.col("source"))


def test_text_is_not_read_after_the_scan(docs):
    results = extract(docs, Job("t", T.StructType([field("email")]), RuleProvider()), cache=empty_cache(docs.sparkSession)).results
    assert "text:string" not in plan(results) and "documents.parquet" not in plan(results)


def test_native_answers_without_a_cache_are_one_pass(docs):
    results = extract(docs, Job("t", T.StructType([field("email")]), RuleProvider())).results
    assert "Exchange" not in plan(results) and "Join" not in plan(results)


def test_no_python_and_no_cross_join_in_native_jobs(spark, docs):
    frames = [
        extract(docs, Job("t", T.StructType([field("email")]), RuleProvider())).results,
        classify.classified(docs, registry({"contracts_Agreement": ("the",)}), classify.keyword_scores(F.col("text"), registry())),
        classify.resolve_names(docs, "lang", registry()),
        entities.tagged_fields(docs.select(F.lit("t").alias("type_key"), F.col("source").alias("field"), F.lit(1).alias("pos"))),
    ]
    for frame in frames:
        text = plan(frame)
        assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text and "Pandas" not in text


def test_classification_does_not_shuffle(docs):
    tree = registry({"contracts_Agreement": ("the", "and")})
    assert "Exchange" not in plan(classify.classified(docs, tree, classify.keyword_scores(F.col("text"), tree)))


def test_references_need_no_join(spark):
    record = T.StructType([field("customer_name"), field("supplier")])
    rows = spark.createDataFrame([("p", "a", "b")], "path string, customer_name string, supplier string")
    done = normalise(rows, record, "path")
    assert "Join" not in plan(done.records) and "Exchange" not in plan(done.records)
    assert "Join" not in plan(done.mentions) and "Exchange" not in plan(done.mentions)


def test_entity_merge_aggregates_before_the_shuffle(spark):
    rows = spark.createDataFrame([("Customer", "a", 1, "x")], "entity string, name string, pos int, website string")
    text = plan(entities.merged_entities(rows, ["pos"], ["website"]))
    assert text.index("Exchange") < text.index("partial_min")  # the plan is printed from the top down


def test_an_empty_cache_leaves_the_plan(spark):
    keys = spark.range(5).select(F.col("id").cast("string").alias("request_key"))
    joined = keys.join(empty_cache(spark), "request_key", "left")
    assert "Join" not in plan(joined)


def test_filters_and_columns_reach_the_scan(spark):
    frame = spark.read.parquet(DOCUMENTS).where("lang = 'en'").select("doc_id")
    text = plan(frame)
    assert "EqualTo(lang,en)" in text and "text:string" not in text
