"""Hard negatives: candidates are chosen by intervals around estimates from rotated one-bit codes, and scored in integers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.session import new_folder, staged

# A component x counts as floor(SCALE * x).
SCALE = 256
# Codes per vector, each of what the ones before leave, and bits of a component of an anchor.
CODES, PLANES = 3, 6
POSITIVES, NEGATIVES = 5, 3
# A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
# Bytes of the anchors that go round at once, and the sides of a tile of estimates.
BLOCK_BYTES = 8 << 20
TILE_ANCHORS, TILE_ROWS = 256, 2048
# Pairs scored in one step.
PAIRS = 1 << 14
# Relative allowance for rounding in the estimates, which are sums of doubles.
SLACK = 1e-9


def rotation(width: int) -> np.ndarray:
    """A fixed orthogonal matrix, so that no direction of the data is one that signs describe badly."""
    q, r = np.linalg.qr(np.random.default_rng(13).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def usable(rows: DataFrame) -> DataFrame:
    """The rows that take part: id and label present, every component a finite number. One row per id."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    if kept.groupBy("vec_id").count().where("count > 1").isEmpty():
        return kept
    first = F.min(F.struct("label", "vector")).alias("row")
    return kept.groupBy("vec_id").agg(first).select("vec_id", "row.label", "row.vector")


def coded(rows: DataFrame, width: int, turn: np.ndarray) -> DataFrame:
    """(vec_id, label, whole, bits, shape): whole components, CODES sign codes of the rotated vector, and their alignments.

    Code m holds the signs of what codes before it leave; its alignment is the inner product of that rest with the
    code as a unit vector. ``shape`` ends with the lengths of the last rest, of the coded part and of the vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.zeros((batch.num_rows, width))
            lists = batch.column(2)
            lengths = np.asarray(lists.value_lengths())
            vectors[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
            vectors = np.floor(SCALE * vectors)
            if np.abs(vectors).max(initial=0) >= 1 << 31 or np.square(vectors).sum(axis=1).max(initial=0) >= 2.0**62:
                raise ValueError("a vector is too long: inner products have to fit 64 bits")
            rest = turned = vectors @ turn.T
            bits, shape = [], []
            for _ in range(CODES):
                positive = rest >= 0
                align = np.abs(rest).sum(axis=1) / np.sqrt(width)
                rest = rest - np.where(positive, 1, -1) * (align / np.sqrt(width))[:, None]
                bits.append(np.packbits(positive, axis=1, bitorder="little"))
                shape.append(align)
            shape += [np.linalg.norm(x, axis=1) for x in (rest, turned - rest, turned)]
            packed = np.concatenate(bits, axis=1)
            numbers = np.stack(shape, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary()),
                    pa.array([b.tobytes() for b in packed], pa.binary()), pa.array([n.tobytes() for n in numbers], pa.binary()),
                ],
                names=["vec_id", "label", "whole", "bits", "shape"],
            )

    return rows.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, whole binary, bits binary, shape binary")


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Rows:
    """Coded vectors of a batch."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, whole: np.ndarray, bits: np.ndarray, shape: np.ndarray):
        self.ids, self.label, self.whole, self.bits, self.shape = ids, label, whole, bits, shape

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Rows:
        columns = [batch.column(c) for c in ("vec_id", "label", "whole", "bits", "shape")]
        bits = matrix(columns[3], "<u8").reshape(batch.num_rows, CODES, -1)
        return cls(np.asarray(columns[0]), np.asarray(columns[1]), matrix(columns[2], "<i4"), bits, matrix(columns[4], "<f8"))

    def take(self, which: np.ndarray | slice) -> Rows:
        return Rows(self.ids[which], self.label[which], self.whole[which], self.bits[which], self.shape[which])


@dataclass
class Anchors:
    """A block of anchors by label and id: whole components, and rotated ones as PLANES bit planes over a grid of their own."""

    ids: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    planes: np.ndarray
    # Lowest grid point, step, sum of the grid numbers, length of the error and of the vector.
    grid: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, turn: np.ndarray) -> Anchors:
        ids, label = np.asarray(table.column("vec_id")), np.asarray(table.column("label"))
        whole = matrix(table.column("whole").combine_chunks(), "<i4")
        order = np.lexsort((ids, label))
        ids, label, whole = ids[order], label[order], whole[order]
        turned = whole @ turn.T
        low, top = turned.min(axis=1, initial=0), turned.max(axis=1, initial=0)
        step = (top - low) / ((1 << PLANES) - 1)
        level = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
        error = turned - (low[:, None] + step[:, None] * level)
        planes = [np.packbits((level >> b) & 1, axis=1, bitorder="little").view("<u8") for b in range(PLANES)]
        lengths = [np.linalg.norm(x, axis=1) for x in (error, turned)]
        return cls(ids, label, whole, np.stack(planes), np.stack([low, step, level.sum(axis=1), *lengths], axis=1))

    def take(self, which: np.ndarray | slice) -> Anchors:
        return Anchors(self.ids[which], self.label[which], self.whole[which], self.planes[:, which], self.grid[which])


def intervals(anchors: Anchors, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and half-width for every pair: the score is certainly inside.

    With x = sum of alignment times code + rest, and q = its grid point + error, the estimate is the inner product of
    grid point and codes, by popcounts of the planes. What it leaves out is at most |q| |rest| + |error| |coded part|.
    """
    width = rows.whole.shape[1]
    low, step, total, error, length = (c[:, None] for c in anchors.grid.T)
    estimate = np.zeros((len(anchors.ids), len(rows.ids)))
    for m in range(CODES):
        code = rows.bits[:, m]
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        above = np.zeros(estimate.shape, np.int64)
        for b in range(PLANES):
            for word in range(code.shape[1]):
                both = np.bitwise_count(anchors.planes[b, :, word][:, None] & code[:, word][None, :])
                above += both.astype(np.int64) << b
        estimate += rows.shape[:, m] * (low * (2 * ones - width) + step * (2 * above - total))
    estimate /= np.sqrt(width)
    rest, part, whole = rows.shape[:, CODES], rows.shape[:, CODES + 1], rows.shape[:, CODES + 2]
    return estimate, length * rest + error * part + SLACK * length * whole + SLACK


def scores(anchors: Anchors, rows: Rows, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (a, r)."""
    out = np.empty(len(a), np.int64)
    for begin in range(0, len(a), PAIRS):
        part = slice(begin, begin + PAIRS)
        out[part] = np.einsum("ij,ij->i", anchors.whole[a[part]].astype(np.int64), rows.whole[r[part]].astype(np.int64))
    return out


class Best:
    """For each of many keys the ``keep`` best (score, id): higher scores first, then smaller ids."""

    def __init__(self, keys: int, keep: int):
        self.keep = keep
        self.score = np.full((keys, keep), np.iinfo(np.int64).min)
        self.id = np.full((keys, keep), np.iinfo(np.int64).max)
        self.known = np.zeros((keys, keep), bool)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        keys = np.unique(key)
        held = self.known[keys]
        every = np.concatenate([np.repeat(keys, held.sum(axis=1)), key])
        score = np.concatenate([self.score[keys][held], score])
        ids = np.concatenate([self.id[keys][held], ids])
        order = np.lexsort((ids, -score, every))
        every, score, ids = every[order], score[order], ids[order]
        rank = np.arange(len(every)) - np.searchsorted(every, every)
        kept = rank < self.keep
        every, score, ids, rank = every[kept], score[kept], ids[kept], rank[kept]
        self.score[every, rank], self.id[every, rank], self.known[every, rank] = score, ids, True

    def least(self) -> np.ndarray:
        """The score that a further one has to reach; the lowest number while there is room."""
        return self.score[:, -1]


def survivors(
    anchors: Anchors, rows: Rows, allowed: np.ndarray, floor, ceiling: np.ndarray, many: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, r, score) of the allowed pairs whose interval meets what ``floor()`` and ``ceiling`` still admit.

    The ``many`` best estimates of every anchor that lie surely low enough come first, since they raise the floor for all others.
    """
    estimate, half = intervals(anchors, rows)
    open_ = allowed & (estimate - half <= ceiling[:, None])
    many = min(many, estimate.shape[1])
    shown = np.where(open_ & (estimate <= ceiling[:, None]), estimate, -np.inf)
    top = np.argpartition(-shown, many - 1, axis=1)[:, :many]
    a = np.repeat(np.arange(len(top)), many)
    r = top.ravel()
    first = open_[a, r] & (estimate[a, r] + half[a, r] >= floor()[a])
    a, r = a[first], r[first]
    yield a, r, scores(anchors, rows, a, r)
    open_[a, r] = False
    a, r = np.nonzero(open_ & (estimate + half >= floor()[:, None]))
    yield a, r, scores(anchors, rows, a, r)


def spans(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values of a sorted array."""
    edges = np.flatnonzero(np.diff(values, prepend=values[:1] - 1 if len(values) else 0))
    for begin, end in zip(edges, [*edges[1:], len(values)], strict=True):
        yield int(values[begin]), slice(int(begin), int(end))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Rows.of(batch)
        for begin in range(0, len(rows.ids), TILE_ROWS):
            yield rows.take(slice(begin, begin + TILE_ROWS))


def anchor_tiles(span: slice) -> Iterator[slice]:
    for begin in range(span.start, span.stop, TILE_ANCHORS):
        yield slice(begin, min(span.stop, begin + TILE_ANCHORS))


def best_positives(anchors: Anchors, batches: Iterator[pa.RecordBatch], keep: int) -> Best:
    """For every anchor the best other rows of its label. Only rows and anchors of one label meet."""
    found = Best(len(anchors.ids), keep)
    spans_of = dict(spans(anchors.label))
    for tile in tiles(batches):
        rows = tile.take(np.argsort(tile.label, kind="stable"))
        for label, span in spans(rows.label):
            some = rows.take(span)
            for at in anchor_tiles(spans_of.get(label, slice(0, 0))):
                near = anchors.take(at)
                allowed = near.ids[:, None] != some.ids[None, :]
                no_ceiling = np.full(len(near.ids), np.inf)
                for a, r, score in survivors(near, some, allowed, lambda at=at: found.least()[at].astype(float), no_ceiling, keep):
                    found.add(a + at.start, score, some.ids[r])
    return found


def best_negatives(anchors: Anchors, positives: np.ndarray, batches: Iterator[pa.RecordBatch], keep: int, low: int, high: int) -> Best:
    """For every anchor and positive the best rows of other labels whose score lies in the positive's window.

    ``positives`` has a row per anchor and a score per positive, with the lowest number where there is none; key
    ``anchor * positives + place`` of the result belongs to one of them.
    """
    many = positives.shape[1]
    found = Best(len(anchors.ids) * many, keep)
    # Below 0 the window is empty, as it is without a positive.
    real = positives >= 0
    lowest = np.where(real, low * np.maximum(positives, 0) / 100, np.inf)
    highest = np.where(real, high * np.maximum(positives, 0) / 100, -np.inf).max(axis=1, initial=-np.inf)
    margin = SLACK * np.abs(highest)
    highest = np.where(np.isfinite(highest), highest + np.where(np.isfinite(margin), margin, 0), highest)

    def floor(at: slice) -> np.ndarray:
        least = found.least().reshape(-1, many)[at].astype(float)
        return np.maximum(lowest[at] * (1 - SLACK), least).min(axis=1, initial=np.inf)

    for rows in tiles(batches):
        for at in anchor_tiles(slice(0, len(anchors.ids))):
            near = anchors.take(at)
            allowed = near.label[:, None] != rows.label[None, :]
            for a, r, score in survivors(near, rows, allowed, lambda at=at: floor(at), highest[at], 4 * keep):
                for place in range(many):
                    mark = positives[at][a, place]
                    # In integers of any length, since a score may be near the largest 64-bit one.
                    fits = (mark >= 0) & within(mark, score, low, high)
                    found.add((a[fits] + at.start) * many + place, score[fits], rows.ids[r[fits]])
    return found


def within(positive: np.ndarray, score: np.ndarray, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive, without overflow."""
    if max(np.abs(positive).max(initial=0), np.abs(score).max(initial=0)) >= 1 << 55:
        positive, score = positive.astype(object), score.astype(object)
    return np.array((low * positive <= 100 * score) & (100 * score <= high * positive), bool)


def hard_negatives(
    rows: DataFrame, anchors: Column, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` names.

    The score of two rows is the inner product of their components, each floor(256 * x). An anchor's positives are its best
    other rows of the same label; for each, the best rows of other labels with a score between ``low`` and ``high`` per cent
    of the positive's are returned. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, or a null or infinite component or NaN, take no part. Of rows that repeat an
    id the one with the smallest label and vector counts. Shorter vectors are filled up with zeros. Labels and ids are whole
    numbers. A component of 2^31 after scaling, or a vector whose square reaches 2^62, is an error, since scores
    have to fit 64 bits. Equal vectors are ties like all others. An empty table, no anchor, one label, or positives
    with a negative score give no rows. Further columns are not looked at.

    Every vector is coded once. The anchors go round in blocks of about ``block_bytes``, each broadcast to two scans of the
    coded rows: one for the positives, one for the negatives. A task keeps the best few per anchor, so a label or
    vector with many rows costs time in proportion and no memory, and no pairs are written.
    """
    spark = rows.sparkSession
    slim = usable(rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    ))
    chosen = rows.where(anchors).select(F.col(id_column).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    longest = slim.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(64, -(-longest // 64) * 64)
    turn = rotation(width)
    table = staged(coded(slim, width, turn), "negatives-coded")
    asked = table.join(chosen, "vec_id", "left_semi").select("vec_id", "label", "whole")
    total = chosen.count()
    blocks = max(1, -(-total * width * 4 // block_bytes))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = staged(asked.select("*", block), "negatives-anchors", "block")
    shared_turn = spark.sparkContext.broadcast(turn)
    folder, written = new_folder(spark, "negatives"), []
    layout = "anchor_id long, positive_id long, positive_score long, found_id long, found_score long"
    names = [c.split()[0] for c in layout.split(", ")]

    def top(found: DataFrame, keep: int) -> DataFrame:
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("found_score"), "found_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    for number in range(blocks):
        some = asked.where(F.col("block") == number).select("vec_id", "label", "whole").toArrow()  # one block
        if not some.num_rows:
            continue
        anchors_of = spark.sparkContext.broadcast(some)

        def same(batches: Iterator[pa.RecordBatch], block=anchors_of) -> Iterator[pa.RecordBatch]:
            near = Anchors.of(block.value, shared_turn.value)
            found = best_positives(near, batches, positives)
            a, k = np.nonzero(found.known)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ids[a]), none, none, pa.array(found.id[a, k]), pa.array(found.score[a, k])], names=names
            )

        pairs = staged(top(table.mapInArrow(same, layout), positives), "negatives-positives")
        known = spark.sparkContext.broadcast(pairs.select("anchor_id", "rank", "found_id", "found_score").toArrow())

        def others(batches: Iterator[pa.RecordBatch], block=anchors_of, known=known) -> Iterator[pa.RecordBatch]:
            near = Anchors.of(block.value, shared_turn.value)
            order = np.argsort(near.ids)
            anchor, rank, ids, score = (np.asarray(known.value.column(c)) for c in ("anchor_id", "rank", "found_id", "found_score"))
            at = order[np.searchsorted(near.ids, anchor, sorter=order)]
            marks = np.full((len(near.ids), positives), np.iinfo(np.int64).min)
            mark_ids = np.zeros((len(near.ids), positives), np.int64)
            marks[at, rank - 1], mark_ids[at, rank - 1] = score, ids
            found = best_negatives(near, marks, batches, negatives, low, high)
            key, k = np.nonzero(found.known)
            a, place = key // positives, key % positives
            columns = (near.ids[a], mark_ids[a, place], marks[a, place], found.id[key, k], found.score[key, k])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        written.append(f"{folder}/block={number}")
        top(table.mapInArrow(others, layout), negatives).write.parquet(written[-1])
        known.unpersist()
        anchors_of.unpersist()
    ranked = f"{layout}, rank int"
    found = spark.read.schema(ranked).parquet(*written) if written else spark.createDataFrame([], ranked)
    return found.select(
        F.col("anchor_id"), F.col("positive_id"), F.col("rank"), F.col("found_id").alias("negative_id"),
        F.col("positive_score"), F.col("found_score").alias("negative_score"),
    )
