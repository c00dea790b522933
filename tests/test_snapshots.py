from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.plans import normalise as N
from foliary.schema import field
from foliary.session import new_folder
from foliary.sinks.snapshots import COMMITS, Snapshots, merged, with_part

SHAPE = T.StructType([field("customer_name"), field("contact_email")])


def run(spark, target, stamp, rows, broken=False):
    records = spark.createDataFrame(rows, "path string, customer_name string, contact_email string")
    parts = {"t": N.normalise(records, SHAPE, "path")}
    entities = N.entity_tables(N.all_mentions(parts.values()))
    if broken:
        entities = entities.withColumn("contact_email", F.raise_error(F.lit("lost")).cast("string"))
    return N.write_database(parts, entities, target, stamp)


def stored(spark, target, version=None):
    people = {r.name: r.contact_email for r in N.stored_entities(spark, target, version).collect()}
    return people, sorted(r.path for r in N.stored_records(spark, target, "t", version).collect())


def test_a_broken_run_changes_nothing(spark, monkeypatch):
    target = new_folder(spark, "db")
    assert N.stored_entities(spark, target) is None and N.stored_records(spark, target, "t") is None
    run(spark, target, "2024-01-01 00:00:00", [("p", "Ann", None)])
    first = stored(spark, target)
    with pytest.raises(Exception, match="lost"):
        run(spark, target, "2024-01-02 00:00:00", [("q", "Bob", "b@x")], broken=True)
    assert stored(spark, target) == first
    with monkeypatch.context() as patched:
        patched.setattr(Snapshots, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            run(spark, target, "2024-01-02 00:00:00", [("q", "Bob", "b@x")])
    assert stored(spark, target) == first
    # A commit file that was cut off counts for nothing, and the next one goes beyond it.
    path = f"{target.removeprefix('file:')}/{COMMITS}/{1:012d}.json"
    with open(path, "w") as cut:
        cut.write('{"schemas": [')
    assert stored(spark, target) == first
    assert run(spark, target, "2024-01-02 00:00:00", [("q", "Ann", "a@x")]) == 2
    assert stored(spark, target) == ({"Ann": "a@x"}, ["p", "q"])
    assert stored(spark, target, 0) == first
    with pytest.raises(ValueError, match="no commit 1"):
        Snapshots(spark, target).tables(1)


def test_the_same_stamp_replaces_its_rows(spark):
    target = new_folder(spark, "db")
    run(spark, target, "2024-01-01 00:00:00", [("p", "Ann", None), ("q", "Bob", "b@x")])
    run(spark, target, "2024-01-02 00:00:00", [("r", "Ann", "a@x")])
    run(spark, target, "2024-01-01 00:00:00", [("p", "Ann", "first@x")])
    assert stored(spark, target) == ({"Ann": "first@x"}, ["p", "r"])
    run(spark, target, "2024-01-03 00:00:00", [])
    assert stored(spark, target) == ({"Ann": "first@x"}, ["p", "r"])


def test_two_writers_of_one_version(spark, monkeypatch):
    store = Snapshots(spark, new_folder(spark, "snap"))
    assert store.commit({}) == 0 and store.tables() == {}
    monkeypatch.setattr(Snapshots, "versions", lambda self: [])
    with pytest.raises(Exception, match="exists"):
        store.commit({})


@pytest.mark.parametrize("fan", [2, 3])
def test_merging_parts_keeps_the_rows(spark, fan):
    rng = random.Random(fan)
    store = Snapshots(spark, new_folder(spark, "snap"))
    parts, first, last = [], {}, {}
    for n in range(8):
        rows = [(k, rng.choice([None, f"v{n}"]), n) for k in rng.sample([None, *range(9)], 4)]
        for k, v, at in rows:
            first[k] = first.get(k) or v
            last[k] = at
        # Later parts have a column that the earlier ones lack, and stand in folders.
        frame = spark.createDataFrame(rows, "k int, v string, at int")
        if n > 3:
            frame = frame.withColumn("w", F.lit(n))
        parts = with_part(parts, store.write(frame, "t", label=str(n)))
        parts = store.compacted("t", parts, lambda r: merged(r, ["k"], ["at"]), fan=fan)
        store.commit({"t": parts})
    assert all([p.level for p in parts].count(level) < fan for level in range(5))
    got = {r.k: (r.v, r["at"]) for r in store.read_merged("t", ["k"], ["at"]).collect()}
    assert got == {k: (first[k], last[k]) for k in first}
    before = set(os.listdir(f"{store.target.removeprefix('file:')}/t"))
    gone = store.drop_obsolete(keep=1)
    assert {r.k: (r.v, r["at"]) for r in store.read_merged("t", ["k"], ["at"]).collect()} == got
    assert len(before) - len(gone) == len(parts) and store.versions() == [7]


def test_a_filter_on_the_entity_reads_its_folders_only(spark):
    target = new_folder(spark, "db")
    run(spark, target, "2024-01-01 00:00:00", [("p", "Ann", None)])
    run(spark, target, "2024-01-02 00:00:00", [("q", "Bob", None)])
    plan = N.stored_entities(spark, target).where("entity = 'Customer'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(entity") == 2
