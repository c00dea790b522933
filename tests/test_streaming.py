from __future__ import annotations

from pyspark.sql import types as T

from foliary.operators.providers import RuleProvider
from foliary.plans.extraction import Job, extract
from foliary.plans.normalise import entity_tables, normalise
from foliary.schema import field
from foliary.session import new_folder
from foliary.sinks.snapshots import Snapshots
from foliary.streaming import incremental

SCHEMA = "doc_id bigint, path string, text string"
SHAPE = T.StructType([field("customer_name"), field("contact_email")])
RULES = {"customer_name": r"for ([A-Z][a-z]+)", "contact_email": r"(\w+@\w+)"}


def test_two_drops_equal_one_batch(spark):
    job = Job("t", SHAPE, RuleProvider(RULES, {}), analyzed_at="2024-01-01 00:00:00")
    rows = [(i, f"p{i}", t) for i, t in enumerate(["for Ann", "for Ann ann@x", "for Bob", "for Ann other@x", "for Bob bob@x", ""])]
    source, target, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    for drop in (rows[:3], rows[3:]):
        spark.createDataFrame(drop, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        incremental.run_available(spark, source, SCHEMA, job, target, state)
    incremental.run_available(spark, source, SCHEMA, job, target, state)  # nothing new
    done = incremental.results(spark, target)
    assert done.select("batch").distinct().count() == 2
    batch = extract(spark.createDataFrame(rows, SCHEMA), job).results
    assert sorted(map(repr, done.select(*batch.columns).collect())) == sorted(map(repr, batch.collect()))

    good = batch.where("status = 'ok'").select("path", "record.customer_name", "record.contact_email")
    want = entity_tables(normalise(good, SHAPE, "path").mentions).select("entity", "name", "contact_email", "entity_id")
    got = incremental.latest_entities(spark, target).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_repeated_batch_leaves_the_same_files(spark):
    job = Job("t", SHAPE, RuleProvider(RULES, {}))
    target = new_folder(spark, "out")
    write = incremental.batch_writer(spark, job, target)
    docs = spark.createDataFrame([(1, "p", "for Ann ann@x")], SCHEMA)
    for batch in (0, 1, 1):
        write(docs, batch)
    assert incremental.results(spark, target).count() == 2
    assert spark.read.parquet(f"{target}/cache").count() == 1
    assert incremental.latest_entities(spark, target).count() == 1


def test_a_batch_writes_only_entities_it_meets(spark):
    job = Job("t", SHAPE, RuleProvider(RULES, {}))
    target = new_folder(spark, "out")
    write = incremental.batch_writer(spark, job, target, fan=4)
    assert incremental.latest_entities(spark, target) is None
    texts = ["for Ann", "for Bob bob@x", "for Ann ann@x", "for Cid", "for Ann other@x", "nobody", "for Bob"]
    for batch, text in enumerate(texts):
        write(spark.createDataFrame([(batch, f"p{batch}", text)], SCHEMA), batch)
        if batch == 2:
            parts = Snapshots(spark, f"{target}/state").tables()["entities"]
            assert [Snapshots(spark, f"{target}/state").rows([p]).count() for p in parts] == [1, 1, 1]
    parts = Snapshots(spark, f"{target}/state").tables()["entities"]
    assert [p.level for p in parts] == [1, 0, 0, 0]

    def state():
        return sorted(map(repr, incremental.latest_entities(spark, target).collect()))

    before = state()
    for batch in (6, 1):  # one that is still apart, one that is merged already
        write(spark.createDataFrame([(batch, f"p{batch}", texts[batch])], SCHEMA), batch)
    assert state() == before
    got = {r.name: (r.contact_email, r.first_seen.batch) for r in incremental.latest_entities(spark, target).collect()}
    assert got == {"Ann": ("ann@x", 0), "Bob": ("bob@x", 1), "Cid": (None, 3)}
