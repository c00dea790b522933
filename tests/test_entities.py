from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.operators import entities as E
from foliary.plans.normalise import (
    ORDER, all_mentions, entity_tables, normalise, stored_entities, stored_records, write_database,
)
from foliary.schema import field
from foliary.session import new_folder


def shape(*names):
    return T.StructType([field(n) for n in names])


@pytest.mark.parametrize(
    "fields, want",
    [
        (["agreement_title"], {"agreement_title": "Position"}),
        (["company_name"], {"company_name": "Customer"}),
        (["employer", "company_name"], {"employer": "Company", "company_name": "Company"}),
        (["budget_allocation"], {"budget_allocation": "Location"}),
        (["licensor", "licensee"], {"licensor": "Company", "licensee": "Customer"}),
        (["document_id"], {"document_id": "Contract"}),
        (["file_path", "document_id"], {"file_path": "Document", "document_id": "Document"}),
        (["name_label", "filename", "siteplan"], {"name_label": "Customer"}),
    ],
)
def test_field_rule(spark, fields, want):
    assert E.entity_fields(shape(*fields)) == want
    frame = spark.createDataFrame([("t", f, i) for i, f in enumerate(fields)], "type_key string, field string, pos int")
    assert {r.field: r.entity for r in E.tagged_fields(frame).collect()} == want


def test_exact_rule():
    assert E.entity_fields(shape("agreement_title", "company_name"), exact_only=True) == {"company_name": "Company"}


def test_nested_enum_and_number_fields_are_no_references():
    record = T.StructType([
        field("customer_name"), field("role", enum=("a",)), field("locations", "array<string>"),
        field("currency", "double"), field("analyzed_at", "timestamp_ntz"), field("effective_date", "date"),
    ])
    assert E.reference_fields(record) == {"customer_name": "Customer"}
    assert E.entity_fields(record)["currency"] == "Currency"


RECORD = T.StructType([
    field("customer_name"), field("contact_email"), field("is_active", "boolean"), field("agreement_id"),
    field("start_date", "date"), field("tags", "array<string>"), field("description"),
])
ROWS = [
    ("p1", " Ann ", " ", True, "A-1", dt.date(2024, 1, 2), ["x"], ""),
    ("p2", "Ann", "ann@x", None, "A-2", None, None, "second"),
    ("p3", "Ann\n", "late@x", False, "A-1", dt.date(2025, 1, 2), [], "third"),
    ("p4", "  ", "b@x", True, None, None, None, None),
]


@pytest.fixture(scope="module")
def normalised(spark):
    rows = spark.createDataFrame(ROWS, T.StructType([T.StructField("path", T.StringType()), *RECORD.fields]))
    return normalise(rows, RECORD, "path")


def test_first_filled_value_wins(normalised):
    rows = {(r.entity, r.name): r for r in entity_tables(normalised.mentions).collect()}
    assert set(rows) == {("Customer", "Ann"), ("Contract", "A-1"), ("Contract", "A-2")}
    ann = rows["Customer", "Ann"]
    assert ann.contact_email == "ann@x" and ann.description == "second" and ann.first_seen.path == "p1"
    assert rows["Contract", "A-1"].effective_date == "2024-01-02"


def test_flat_records_refer_by_id(normalised, spark):
    ids = {(r.entity, r.name): r.entity_id for r in entity_tables(normalised.mentions).collect()}
    rows = {r.path: r for r in normalised.records.collect()}
    assert rows["p1"].customer_name_id == rows["p3"].customer_name_id == ids["Customer", "Ann"]
    assert rows["p4"].customer_name_id is None and rows["p4"].agreement_id_id is None
    assert rows["p1"].tags == '["x"]' and rows["p1"].is_active is True


def test_result_does_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    rows = [(0, f"p{i:04}", i % 3, "Customer", rng.choice(["hot"] * 5 + list("abcdef")), rng.choice([None, "", " ", "m1", "m2"])) for i in range(600)]
    schema = "batch bigint, path string, pos int, entity string, name string, contact_email string"
    got = [sorted(map(repr, E.merged_entities(spark.createDataFrame(rng.sample(rows, 600), schema).repartition(n), ORDER).collect())) for n in (1, 7)]
    assert got[0] == got[1]
    want = next(r[5] for r in sorted(rows) if r[4] == "hot" and r[5] and r[5].strip())
    merged = E.merged_entities(spark.createDataFrame(rows, schema), ORDER)
    assert merged.where("name = 'hot'").first().contact_email == want


def test_upsert_equals_one_merge(spark):
    schema = "batch bigint, path string, pos int, entity string, name string, contact_email string, website string"
    old = [(0, "p1", 0, "Customer", "Ann", None, "w1"), (0, "p2", 0, "Customer", "Bob", "b@x", None)]
    new = [(1, "p0", 0, "Customer", "Ann", "ann@x", "w2"), (1, "p3", 0, "Vendor", "Ann", None, None)]
    one = E.merged_entities(spark.createDataFrame(old + new, schema), ORDER)
    two = E.upserted(E.merged_entities(spark.createDataFrame(old, schema), ORDER), spark.createDataFrame(new, schema), ORDER)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_harvest_prefers_fields_and_metadata_hides_the_description(spark):
    frame = spark.createDataFrame(
        [({"website": "", "url": "u", "description": "own"}, {"company_website": "m", "sector": "s"}),
         ({"description": "own"}, {}), ({"description": "own"}, None)],
        "d map<string,string>, m map<string,string>",
    )
    found = E.harvested(F.col("d"), F.col("m"), "Company", "company_name")
    rows = [tuple(r) for r in frame.select(found["website"], found["industry"], found["description"]).collect()]
    assert rows == [("u", "s", None), (None, None, "own"), (None, None, "own")]


def test_delete_removes_orphans(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, ref string")
    deleted = spark.createDataFrame([("a",)], "ref string")
    assert [r.id for r in E.kept_after_delete(records, deleted, "ref", ["id"]).collect()] == [2]
    assert [r.id for r in E.removed_by_delete(records, deleted, "ref", ["id"]).collect()] == [1]


def test_database(spark, normalised):
    target = new_folder(spark, "db")
    write_database({"rec": normalised}, entity_tables(all_mentions([normalised])), target, "2024-01-01 00:00:00")
    stored = stored_entities(spark, target)
    assert stored.where("entity = 'Contract'").count() == 2 and "created_at" in stored.columns
    assert stored_records(spark, target, "rec").count() == 4


def test_a_second_run_keeps_what_is_stored(spark):
    shape = T.StructType([field("customer_name"), field("contact_email")])
    target = new_folder(spark, "database")
    for stamp, rows in (("2024-01-01 00:00:00", [("p", "Ann", None), ("q", "Bob", "b@x")]), ("2024-01-02 00:00:00", [("r", "Ann", "a@x"), ("s", "Cid", None)])):
        parts = {"t": normalise(spark.createDataFrame(rows, "path string, customer_name string, contact_email string"), shape, "path")}
        write_database(parts, entity_tables(all_mentions(parts.values())), target, stamp)
    stored = {r.name: (r.contact_email, str(r.created_at)[:10], str(r.updated_at)[:10]) for r in stored_entities(spark, target).collect()}
    assert stored == {"Ann": ("a@x", "2024-01-01", "2024-01-02"), "Bob": ("b@x", "2024-01-01", "2024-01-01"), "Cid": (None, "2024-01-02", "2024-01-02")}
    assert stored_records(spark, target, "t").count() == 4
