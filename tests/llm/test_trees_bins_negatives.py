"""Hash trees, genetic bin packing and hard negatives against plain Python, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from foliary.llm import binpacking, merkle, negatives
from foliary.llm.packing import default_tokenizer

NOISE = ["position", "tree", "digest", "path", "slot", "item", "length", "problem", "bin", "block", "score", "rank"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity):
    """(root, path of every node), where a path is a list of (before, after)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for node, path in zip(at, paths, strict=True):
            first = node // arity * arity
            path.append((nodes[first:node], nodes[node + 1: first + arity]))
        nodes = [digest("".join(nodes[i: i + arity])) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], paths


def fold(node, path):
    for before, after in path:
        node = digest("".join([*before, node, *after]))
    return node


def brute_manifest(rows, arity, altered):
    """rows: (doc_id, text, lang, source, n_chars); altered gives the text of the copy."""
    trees = defaultdict(list)
    for row in rows:
        doc_id, text, lang, source, n_chars = row
        plain, other = (leaf((doc_id, source, lang, n_chars, t)) for t in (text, altered(doc_id, text)))
        trees["" if source is None else "s" + source].append(((doc_id is not None, doc_id or 0), plain, other, doc_id))
    names = sorted(trees, key=str.encode)
    built = {n: climb([x[1] for x in sorted(trees[n])], arity) for n in names}
    root, upper = climb([built[n][0] for n in names], arity)
    out = []
    for name, above in zip(names, upper, strict=True):
        subroot, paths = built[name]
        for (_, plain, other, doc_id), path in zip(sorted(trees[name]), paths, strict=True):
            whole = path + above
            proof = digest("".join("".join([*b, *a]) for b, a in whole))
            end = fold(other, whole)
            out.append((doc_id, plain, subroot, root, proof, end))
    return out


def tree_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a\nb", "plain", "Ünï\n\n", "x" * 5000]), rng.choice(["en", None]), rng.choice(["big", "big", "big", "b", None, "é", ""]), i)
            for i in range(120)]
    rows += [(None, "no id", "en", "big", None), (None, None, None, None, None), (7, "again", "en", "big", 1), (7, "again", "en", "big", 1)]
    rows += [(500, "alone\n", "de", "only", 3)]
    rng.shuffle(rows)
    return rows


DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in NOISE],
])


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest(spark, arity):
    rows = tree_rows()
    frame = spark.createDataFrame([(*r, *["noise"] * len(NOISE)) for r in rows], DOCS).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(frame, arity=arity, altered=F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))))
    shown = found.select(
        "doc_id", *[merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.path_digest(F.col("path")).alias("proof"), merkle.as_text(merkle.folded(F.col("altered_leaf"), F.col("path"))).alias("end"),
    )

    def altered(doc_id, text):
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        return text.replace("\n", "") if hit and text is not None else text

    wanted = brute_manifest(rows, arity, altered)
    assert Counter(map(tuple, shown.collect())) == Counter(wanted)
    assert {end == root for *_, root, _, end in wanted} == {True, False}


def test_manifest_of_few_rows(spark):
    frame = spark.createDataFrame([(*r, *["noise"] * len(NOISE)) for r in tree_rows()[:1]], DOCS)
    one = merkle.manifest(frame).first()
    assert one["leaf"] == one["subroot"] == one["root"] and not one["path"]
    assert merkle.manifest(frame.limit(0)).count() == 0


def test_a_hot_source_is_no_single_task(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"),
    )
    found = merkle.manifest(docs)
    assert found.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 4000
    assert found.select("root").distinct().count() == 1


def exact_packing_possible(sizes, capacity):
    return -(-sum(sizes) // capacity)


def valid(bin_of, sizes, capacity):
    assert (bin_of >= 0).all() and binpacking.fill(bin_of, sizes).max() <= capacity
    assert set(bin_of.tolist()) == set(range(int(bin_of.max()) + 1))


@pytest.mark.parametrize("kind", ["uniform", "large", "tiny", "equal", "one", "pairs"])
def test_solutions_hold_everything(kind):
    rng = np.random.default_rng(3)
    sizes = {
        "uniform": rng.integers(1, 1024, 700), "large": rng.integers(500, 1024, 300), "tiny": np.ones(3000, np.int64),
        "equal": np.full(400, 400), "one": np.array([5]), "pairs": np.concatenate([x := rng.integers(1, 1024, 300), 1024 - x]),
    }[kind].astype(np.int64)
    first = binpacking.first_solutions(sizes, 1024, 4, rng)
    for bin_of in first:
        valid(bin_of, sizes, 1024)
    child = binpacking.child_of(first[0], first[-1], sizes, 1024, rng)
    valid(child, sizes, 1024)
    found = binpacking.evolve(first, sizes, 1024, 30, rng, 4)
    valid(found[0], sizes, 1024)
    bins = [int(b.max()) + 1 for b in first]
    assert len(found) <= 4 and int(found[0].max()) + 1 <= min(bins)
    if kind in ("tiny", "pairs"):
        assert int(found[0].max()) + 1 == -(-int(sizes.sum()) // 1024)
    if kind == "equal":
        assert int(found[0].max()) + 1 == 200


def test_full_bins_are_injected_whole():
    sizes = np.array([600, 424, 500, 524, 300, 300], np.int64)
    giver = np.array([0, 0, 1, 1, 2, 2], np.int32)
    receiver = np.array([0, 1, 1, 2, 0, 2], np.int32)
    child = binpacking.child_of(receiver, giver, sizes, 1024, np.random.default_rng(0))
    valid(child, sizes, 1024)
    assert child[0] == child[1] or child[2] == child[3]


def test_pack_best(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "word " * 5000, "x" * 9000, *[" ".join(rng.choice(["the", "Über", "x1", "日本"]) for _ in range(rng.randrange(1, 900))) for _ in range(150)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, texts[5]), (5, texts[5])] + [(900, None)] * 80
    schema = T.StructType([*DOCS.fields[:2], *DOCS.fields[5:]])
    docs = spark.createDataFrame([(*r, *["noise"] * len(NOISE)) for r in rows], schema).repartition(3)
    found = binpacking.pack_best(docs, items=64, children=10, epochs=2).collect()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    wanted = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            wanted[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(sequences) <= 1.03 * total / 1024 + 2
    assert binpacking.pack_best(docs.limit(0)).count() == 0


def test_whole_windows_only(spark):
    docs = spark.createDataFrame([(1, "a" * 1, "n")], "doc_id long, text string, item string")
    found = binpacking.pack_best(docs, window=2).collect()
    assert [(r.piece, r.start, r.length, r.offset) for r in found] == [(0, 0, 2, 0)]


def brute_negatives(rows, positives=5, keep=3, low=50, high=95, of=lambda i: i % 50 == 0):
    usable = {}
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if i not in usable or (label, vector) < usable[i]:
            usable[i] = (label, vector)
    longest = max((len(v) for _, v in usable.values()), default=0)
    whole = {i: [int(np.floor(256 * x)) for x in v] + [0] * (longest - len(v)) for i, (_, v) in usable.items()}
    out = []
    for a in usable:
        if not of(a):
            continue
        score = {i: sum(x * y for x, y in zip(whole[a], whole[i], strict=True)) for i in usable if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if usable[i][0] == usable[a][0]][:positives]:
            near = [i for i in ranked if usable[i][0] != usable[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(near[:keep])]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, whole string, bits string, shape string, block string, rank string"


def negatives_of(spark, rows, **options):
    frame = spark.createDataFrame([(*r, *["noise"] * 5) for r in rows], VECTORS).repartition(3)
    return Counter(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0, **options).collect()))


@pytest.mark.parametrize("width", [3, 64, 100])
def test_negatives(spark, width):
    rng = np.random.default_rng(width)
    centres = rng.standard_normal((4, width))
    rows = []
    for i in range(600):
        vector = (centres[i % 4] + 0.7 * rng.standard_normal(width)).astype(np.float32).tolist()
        rows.append((i, vector, int(rng.integers(0, 3))))
    hot = rows[1][1]
    rows += [(i, hot, i % 3) for i in range(600, 900)]  # a third of all rows are one vector
    rows += [(1000, None, 1), (1050, hot, None), (None, hot, 1), (1100, [1.0, None], 1), (1150, [float("inf")] * width, 1), (1200, [float("nan")], 0)]
    rows += [(1250, [], 1), (1300, [0.0] * width, 2), (1350, hot[:2], 0), (50, rows[50][1], rows[50][2]), (100, hot, 0), (-50, hot, 2)]
    wanted = Counter(brute_negatives(rows))
    assert len(wanted) > 100
    assert negatives_of(spark, rows) == wanted
    assert negatives_of(spark, rows, block_bytes=4096) == wanted


def test_negatives_of_poor_tables(spark):
    assert not negatives_of(spark, [])
    assert not negatives_of(spark, [(0, [1.0], 1), (1, [1.0], 1)])  # one label
    assert not negatives_of(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [1.0], 2)])  # the positive's score is negative
    assert not negatives_of(spark, [(1, [1.0], 1), (2, [1.0], 2)])  # no anchor
    zero = [(0, [0.0], 1), (1, [5.0], 1), (2, [-3.0], 2)]
    assert negatives_of(spark, zero) == Counter(brute_negatives(zero)) != Counter()


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(1)
    width = 128
    turn = negatives.rotation(width)
    import pyarrow as pa

    whole = np.floor(256 * rng.standard_normal((400, width)))
    whole[3], whole[4] = 0, 1
    table = pa.table({"vec_id": np.arange(400), "label": np.zeros(400, np.int64), "whole": pa.array([w.astype("<i4").tobytes() for w in whole], pa.binary())})
    anchors = negatives.Anchors.of(table, turn)
    rest = turned = whole @ turn.T
    bits, shape = [], []
    for _ in range(negatives.CODES):
        sign, align = rest >= 0, np.abs(rest).sum(axis=1) / np.sqrt(width)
        rest = rest - np.where(sign, 1, -1) * (align / np.sqrt(width))[:, None]
        bits.append(np.packbits(sign, axis=1, bitorder="little").view("<u8"))
        shape.append(align)
    shape += [np.linalg.norm(x, axis=1) for x in (rest, turned - rest, turned)]
    rows = negatives.Rows(np.arange(400), np.zeros(400), whole.astype(np.int32), np.stack(bits, axis=1), np.stack(shape, axis=1))
    estimate, half = negatives.intervals(anchors, rows)
    true = whole @ whole.T
    assert (np.abs(true - estimate) <= half).all()
    norm = np.linalg.norm(whole, axis=1)
    sure = estimate + half < 0.45 * np.outer(norm, norm)
    assert sure.mean() > 0.8  # most unrelated pairs are ruled out without a product
