"""Documents in as few sequences as possible: a grouping genetic algorithm on islands with migration of the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.packing import check_sum, default_tokenizer, encoder, text_slices
from foliary.session import staged

WINDOW = 1024
END_ID = 2
# Items of one problem, islands that work on it, solutions per island, children per epoch, epochs, rounds of leftovers.
ITEMS, ISLANDS, POPULATION, CHILDREN, EPOCHS = 16_384, 2, 4, 40, 3
ROUNDS = 2
# The share of a parent's full bins that a crossover injects, and how many sizes a search for three that fill a bin tries.
INJECTED = 0.02
TRIES = 12
# Numbers of sequences: whole windows, then by round, problem and bin.
WHOLE, ROUND, PROBLEM = 1 << 62, 1 << 56, 1 << 16


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32): a longer document is cut into whole windows after a shorter first piece.

    ``item`` tells rows apart that are alike; it is pinned by writing the result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            for row, texts in text_slices(batch.column(1)):
                out: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(texts):
                    ids = np.append(encode.ids(text), np.uint16(end_id))
                    begin = 0
                    for number, stop in enumerate(range(len(ids) % window or window, len(ids) + 1, window)):
                        out.append((row + i, number, begin, stop - begin, check_sum(ids[begin:stop])))
                        begin = stop
                columns = np.array(out, np.int64).T
                numbers = np.arange(item, item + len(out))
                item += len(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers), batch.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)),
                        *[pa.array(c) for c in columns[2:]],
                    ],
                    names=["item", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    layout = f"item long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, layout)


def best_fit(bin_of: np.ndarray, items: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
    """Puts ``items``, in the order given, each into the fullest bin that takes it, or into a new one.

    The bins with room stand in stacks by their free space, and a whole number has a bit per stack that is not empty.
    """
    placed = bin_of >= 0
    count = int(bin_of.max(initial=-1)) + 1
    room = capacity - fill(bin_of[placed], sizes[placed], count)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b in np.flatnonzero((room > 0) & (room < capacity)).tolist():
        with_room[room[b]].append(b)
        mask |= 1 << int(room[b])
    for item, size in zip(items.tolist(), sizes[items].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            held = with_room[space]
            b = held.pop()
            if not held:
                mask ^= 1 << space
            left = space - size
        else:
            b, left = count, capacity - size
            count += 1
        bin_of[item] = b
        if left:
            with_room[left].append(b)
            mask |= 1 << left


class Stock:
    """Loose items by size. One whole number has a bit per size in stock, another the same bits in reverse, so that
    one shift and one AND show every pair of sizes with a given sum."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray, capacity: int):
        self.capacity = capacity
        self.of: list[list[int]] = [[] for _ in range(capacity + 1)]
        for item, size in zip(items.tolist(), sizes[items].tolist(), strict=True):
            self.of[size].append(item)
        self.bits = self.mirror = 0
        for size in np.unique(sizes[items]).tolist():
            self.turn(size)

    def turn(self, size: int) -> None:
        self.bits ^= 1 << size
        self.mirror ^= 1 << (self.capacity - size)

    def take(self, size: int) -> int:
        item = self.of[size].pop()
        if not self.of[size]:
            self.turn(size)
        return item

    def pair(self, total: int) -> int:
        """The larger of two sizes in stock that make up ``total``, as near to each other as there are; 0 if none."""
        half = (total + 1) // 2
        found = (self.bits & (self.mirror >> (self.capacity - total))) >> half << half
        while found:
            size = (found & -found).bit_length() - 1
            if 2 * size != total or len(self.of[size]) > 1:
                return size
            found ^= 1 << size
        return 0

    def next_sizes(self, room: int) -> list[int]:
        """Sizes that fill ``room`` exactly, one, two or three of them; else the largest that fits, or nothing."""
        if self.bits >> room & 1:
            return [room]
        size = self.pair(room)
        if size:
            return [size, room - size]
        fitting = left = self.bits & ((1 << (room + 1)) - 1)
        for _ in range(TRIES):
            size = left.bit_length() - 1
            if size <= 0:
                break
            left ^= 1 << size
            item = self.take(size)
            second = self.pair(room - size)
            if not self.of[size]:
                self.turn(size)
            self.of[size].append(item)
            if second:
                return [size, second, room - size - second]
        return [fitting.bit_length() - 1] if fitting else []


def exact_fit(bin_of: np.ndarray, items: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
    """New bins for ``items``: the largest one left, and what fills its bin best, looking three sizes ahead."""
    stock = Stock(items, sizes, capacity)
    count = int(bin_of.max(initial=-1)) + 1
    while stock.bits:
        size = stock.bits.bit_length() - 1
        bin_of[stock.take(size)] = count
        room = capacity - size
        while room:
            more = stock.next_sizes(room)
            if not more:
                break
            for size in more:
                bin_of[stock.take(size)] = count
                room -= size
        count += 1


def renumbered(bin_of: np.ndarray) -> np.ndarray:
    """The same bins with numbers from 0 on without gaps; -1 stays."""
    used, numbers = np.unique(bin_of, return_inverse=True)
    return (numbers - (used[0] == -1)).astype(np.int32) if len(used) else bin_of


def fill(bin_of: np.ndarray, sizes: np.ndarray, count: int = 0) -> np.ndarray:
    return np.bincount(bin_of, sizes, count).astype(np.int64)


def fitness(bin_of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose free space lies in fewer bins."""
    held = fill(bin_of, sizes)
    return -len(held), float(np.square(held / capacity).sum())


def first_solutions(sizes: np.ndarray, capacity: int, many: int, rng: np.random.Generator) -> list[np.ndarray]:
    """One solution that looks ahead, and best-fit ones by falling size, all but the first with a little noise."""
    everything = np.arange(len(sizes))
    out = [np.full(len(sizes), -1, np.int32) for _ in range(many)]
    exact_fit(out[0], everything, sizes, capacity)
    for number, bin_of in enumerate(out[1:]):
        noise = rng.random(len(sizes)) * capacity * 0.02 if number else 0
        best_fit(bin_of, np.argsort(-(sizes + noise), kind="stable"), sizes, capacity)
    return out


def child_of(receiver: np.ndarray, giver: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole full bins of ``giver`` enter ``receiver``, whose bins with one of their items are dissolved.

    So are the receiver's bins that are not full, and as many full ones. The displaced documents are fitted anew.
    """
    full = np.flatnonzero(fill(giver, sizes) == capacity)
    injected = np.zeros(int(giver.max()) + 1, bool)
    if len(full):
        injected[rng.choice(full, max(1, int(len(full) * INJECTED)), replace=False)] = True
    moved = injected[giver]
    own = fill(receiver, sizes)
    broken = own < capacity
    broken |= rng.random(len(own)) < broken.mean()
    broken[receiver[moved]] = True
    child = renumbered(np.where(moved, giver + len(own), np.where(broken[receiver], -1, receiver)))
    loose = rng.permutation(np.flatnonzero(child < 0))
    if rng.random() < 0.7:
        exact_fit(child, loose, sizes, capacity)
    else:
        noise = rng.random(len(loose)) * capacity * 0.02
        best_fit(child, loose[np.argsort(-(sizes[loose] + noise), kind="stable")], sizes, capacity)
    return child


def evolve(
    population: list[np.ndarray], sizes: np.ndarray, capacity: int, children: int, rng: np.random.Generator, keep: int
) -> list[np.ndarray]:
    """An epoch of one island: the ``keep`` best solutions, best first. It ends early when none can have fewer bins."""
    least = -(-int(sizes.sum()) // capacity)

    def best(scored: list[tuple[tuple[int, float], np.ndarray]]) -> list[tuple[tuple[int, float], np.ndarray]]:
        return sorted(scored, key=lambda s: s[0], reverse=True)[:keep]

    scored = best([(fitness(p, sizes, capacity), p) for p in population])
    for _ in range(children):
        if -scored[0][0][0] <= least:
            break
        a, b = sorted(rng.choice(len(scored), 2, replace=False)) if len(scored) > 1 else (0, 0)
        child = child_of(scored[a][1], scored[b][1], sizes, capacity, rng)
        scored = best([*scored, (fitness(child, sizes, capacity), child)])
    return [p for _, p in scored]


def as_bytes(solutions: list[np.ndarray]) -> list[bytes]:
    return [s.astype("<u2").tobytes() for s in solutions]


def solution(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2").astype(np.int32)


STATE = "problem long, island int, sizes binary, solutions array<binary>, bins long, score double"


def epoch(states: DataFrame, capacity: int, number: int, children: int, population: int) -> DataFrame:
    """One epoch of every island of ``states`` (problem, island, sizes, solutions). Its chance numbers hang on these names alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<u2").astype(np.int64)
                rng = np.random.default_rng([row["problem"], row["island"], number])
                solutions = [solution(s) for s in row["solutions"]] or first_solutions(sizes, capacity, population, rng)
                found = evolve(solutions, sizes, capacity, children, rng, population)
                bins, score = fitness(found[0], sizes, capacity)
                yield pa.RecordBatch.from_pylist(
                    [{**row, "solutions": as_bytes(found), "bins": -bins, "score": score}],
                    schema=pa.schema([
                        ("problem", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()),
                        ("solutions", pa.list_(pa.binary())), ("bins", pa.int64()), ("score", pa.float64()),
                    ]),
                )

    return states.select("problem", "island", "sizes", "solutions").mapInArrow(run, STATE)


def problems_of(items: DataFrame, many: int) -> DataFrame:
    """(problem, items, sizes): items (item, length) dealt at random to ``many`` problems, largest first, one row per problem."""

    def run(table: pa.Table) -> pa.Table:
        item, size = table.column("item").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((item, -size))
        return pa.table({
            "problem": table.column("problem").slice(0, 1), "items": pa.array([item[order].tobytes()], pa.binary()),
            "sizes": pa.array([size[order].astype("<u2").tobytes()], pa.binary()),
        })

    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(many)).alias("problem"), "item", "length")
    return dealt.groupBy("problem").applyInArrow(run, "problem long, items binary, sizes binary")


def solved(
    items: DataFrame, many: int, capacity: int, *, islands: int, population: int, children: int, epochs: int
) -> DataFrame:
    """(item, length, problem, bin, offset, held): the best packing found for each problem of about ITEMS items.

    Every problem is evolved on ``islands`` islands, each a row of its own, so islands of all problems run side by side.
    Between epochs the best solution of an island moves on to the next one, by a join.
    """
    posed = staged(problems_of(items, many), "packing-problems")
    island = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    none = F.array().cast("array<binary>").alias("solutions")
    tasks = max(1, many * islands)
    states = posed.select("problem", island, "sizes", none).repartition(tasks, "problem", "island")
    for number in range(epochs):
        if number:
            guests = states.select(
                F.col("problem").alias("__problem"), F.pmod(F.col("island") + 1, F.lit(islands)).alias("__island"),
                F.slice("solutions", 1, 1).alias("guest"),
            )
            same = (states["problem"] == guests["__problem"]) & (states["island"] == guests["__island"])
            states = states.join(guests, same).select(
                "problem", "island", "sizes", F.concat("solutions", "guest").alias("solutions")
            ).repartition(tasks, "problem", "island")
        states = staged(epoch(states, capacity, number, children, population), "packing-islands")
    rank = F.struct(-F.col("bins"), "score", -F.col("island"))
    best = states.groupBy("problem").agg(F.max_by(F.element_at("solutions", 1), rank).alias("best"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                item, bin_of = np.frombuffer(row["items"], np.int64), solution(row["best"])
                size = np.frombuffer(row["sizes"], "<u2").astype(np.int64)
                order = np.argsort(bin_of, kind="stable")
                bin_of, size = bin_of[order], size[order]
                before = np.cumsum(size) - size
                first = np.searchsorted(bin_of, bin_of)
                held = fill(bin_of, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(item[order]), pa.array(size), pa.array(np.full(len(item), row["problem"])),
                        pa.array(bin_of.astype(np.int64)), pa.array(before - before[first]), pa.array(held[bin_of]),
                    ],
                    names=["item", "length", "problem", "bin", "offset", "held"],
                )

    return posed.join(best, "problem").select("problem", "items", "sizes", "best").mapInArrow(
        opened, "item long, length long, problem long, bin long, offset long, held long"
    )


def pack_best(
    docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, items: int = ITEMS,
    islands: int = ISLANDS, population: int = POPULATION, children: int = CHILDREN, epochs: int = EPOCHS, rounds: int = ROUNDS,
) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, for all of (doc_id, text).

    A document is its ids and ``end_id``; a null or empty text has ``end_id`` alone. One that is longer than ``window`` is
    cut into whole windows after a shorter first piece; whole windows are sequences as they are. Everything else is
    dealt at random to problems of about ``items`` items, so no source or group of copies shapes one. Only the full
    bins of a round are final: what is left of all problems is dealt anew to fewer ones, and the last round keeps all.
    Ties fall by chance numbers that hang on problem, island and epoch alone. Repeated rows are packed each; an empty table
    gives no rows; further columns are not looked at. ``tokenizer`` is the path of a file that every executor has.
    """
    if not 1 < window <= 1 << 15 or not 0 < items <= 1 << 15:
        raise ValueError("window and items have to fit 15 bits")
    cut = staged(pieces(docs, tokenizer or default_tokenizer(), window, end_id), "packing-pieces")
    left, done = cut.where(F.col("length") < window).select("item", "length"), None
    for turn in range(rounds):
        many = -(-left.count() // items)
        if not many:
            break
        found = staged(
            solved(left, many, window, islands=islands, population=population, children=children, epochs=epochs), "packing-bins"
        )
        final = found if turn == rounds - 1 else found.where(F.col("held") == window)
        number = F.lit(turn * ROUND) + F.col("problem") * PROBLEM + F.col("bin")
        final = final.select("item", number.alias("sequence_id"), "offset")
        done = final if done is None else done.union(final)
        left = found.where(F.col("held") < window).select("item", "length")
    whole = cut.where(F.col("length") == window).select(
        "*", (F.lit(WHOLE) + F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    if done is not None:
        whole = whole.union(cut.where(F.col("length") < window).join(done, "item").select(whole.columns))
    return whole.drop("item")
