"""Joins, numbering and naming with one key that owns a third of the rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliary.operators.naming import unique_names
from foliary.operators.skew import hot_keys, ordinal, skew_join
from foliary.session import shared_folder


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    keys = ["hot"] * 400 + [None] * 200 + [f"k{rng.randrange(300)}" for _ in range(600)]
    return [(i, k) for i, k in enumerate(keys)]


def test_hot_keys_are_few(spark, rows):
    frame = spark.createDataFrame(rows, "id int, k string")
    assert {(r.k, r["__salts"]) for r in hot_keys(frame, ["k"], 100).collect()} == {("hot", 4), (None, 2)}
    assert hot_keys(frame, ["id"], 1).count() == 0


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join(spark, rows, how, no_broadcast):
    left = spark.createDataFrame(rows, "id int, k string")
    known = {k: f"v-{k}" for _, k in rows if k and (k == "hot" or hash(k) % 2)}
    right = spark.createDataFrame([*known.items(), (None, "never")], "k string, v string")
    got = sorted((tuple(r) for r in skew_join(left, right, ["k"], how, spread=["id"], hot_rows=20).collect()), key=repr)
    want = {
        "left": [(k, i, known.get(k)) for i, k in rows],
        "inner": [(k, i, known[k]) for i, k in rows if k in known],
        "left_semi": [(k, i) for i, k in rows if k in known],
        "left_anti": [(k, i) for i, k in rows if k not in known],
    }[how]
    assert got == sorted(want, key=repr)


def test_hot_rows_are_spread(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.createDataFrame(rows, "id int, k string")
        right = left.where("k is not null").select("k").distinct().withColumn("v", F.upper("k"))
        joined = skew_join(left, right, ["k"], spread=["id"], hot_rows=20).where("k = 'hot'")
        tasks = {r[0] for r in joined.select(F.spark_partition_id()).distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1


def test_outer_rows_of_the_right_are_refused(spark, rows):
    frame = spark.createDataFrame(rows, "id int, k string")
    with pytest.raises(ValueError):
        skew_join(frame, frame, ["k"], "full", spread=["id"])


@pytest.mark.parametrize("slices", [None, 1, 3, 16])
def test_ordinal(spark, rows, slices):
    shuffled = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "id int, k string")
    got = {r.id: r.n for r in ordinal(shuffled, ["k"], ["id"], "n", slices=slices).collect()}
    seen: Counter = Counter()
    for i, k in rows:
        seen[k] += 1
        assert got[i] == seen[k]


def sequential_names(items):
    """The n-th further file of a base takes the n-th number whose name nobody really has."""
    real = {(f, b) for _, f, b in items}
    first, last, names = set(), {}, {}
    for i, f, b in items:
        if (f, b) not in first:
            first.add((f, b))
            names[i] = b
            continue
        n = last.get((f, b), 0) + 1
        while (f, f"{b}_{n}") in real:
            n += 1
        last[f, b] = n
        names[i] = f"{b}_{n}"
    return names


@pytest.mark.parametrize("seed", range(4))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    bases = ["x", "x", "x", "x_1", "x_2", "x_5", "x_1_1", "y", "y_01", "y_3"]
    items = [(i, rng.choice("ab"), rng.choice(bases)) for i in range(120)]
    frame = spark.createDataFrame(items, "id int, folder string, base string").repartition(5)
    got = {r.id: r.name for r in unique_names(frame, "folder", "base", ["id"]).collect()}
    assert got == sequential_names(items)
    assert len({(f, got[i]) for i, f, _ in items}) == len(items)


@pytest.mark.parametrize("seed", range(4))
def test_names_beside_existing_ones(spark, seed):
    rng = random.Random(seed)
    bases = ["x", "x", "x", "x_1", "x_2", "x_1_1", "y", "y_01", "z"]
    items = [(i, rng.choice("ab"), rng.choice(bases)) for i in range(90)]
    there = {(rng.choice("abc"), rng.choice([*bases, "x_7", "x_900", "y_1", "w", "x_2_1"])) for _ in range(12)}
    real = {(f, b) for _, f, b in items}
    want, used = {}, set(there)
    for i, f, b in items:
        numbers = (k for k in range(1000) if (f, f"{b}_{k}" if k else b) not in used and (k == 0 or (f, f"{b}_{k}") not in real))
        number = next(numbers)
        want[i] = f"{b}_{number}" if number else b
        used.add((f, want[i]))
    frame = spark.createDataFrame(items, "id int, folder string, base string").repartition(5)
    existing = spark.createDataFrame(sorted(there), "folder string, base string")
    got = {r.id: r.name for r in unique_names(frame, "folder", "base", ["id"], existing=existing).collect()}
    assert got == want and len({(f, got[i]) for i, f, _ in items} | there) == len(items) + len(there)
    alone = unique_names(frame, "folder", "base", ["id"], existing=existing.where("false"))
    assert {r.id: r.name for r in alone.collect()} == sequential_names(items)


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
