"""Documents that hold a benchmark item within an edit distance: pieces without an error, then bit-parallel distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.1
BLOCK_BYTES = 8 << 20


def normal(text: str | None) -> str:
    """Lower-cased, with runs of white space as one space."""
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, letter in enumerate(pattern):
        found[letter] = found.get(letter, 0) | (1 << i)
    return found


def best_distance(places: dict[str, int], size: int, text: str) -> int:
    """Smallest edit distance of the pattern to any substring of ``text`` (Myers' bit-parallel columns)."""
    every = (1 << size) - 1
    last = 1 << (size - 1)
    up, down, score, best = every, 0, size, size
    for letter in text:
        same = places.get(letter, 0)
        flat = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (~(across | up) & every), up & across
        if more & last:
            score += 1
        elif less & last:
            score -= 1
            if score < best:
                best = score
        more, less = (more << 1) & every, (less << 1) & every
        up, down = less | (~(flat | more) & every), more & flat
    return best


class Item:
    """A test item cut into one piece more than the errors it may have.

    With at most that many errors some piece has none. More generally, a run of m pieces with fewer than m errors
    has a half of which the same holds, so a hit is confirmed from its piece upwards, through runs of doubled size,
    and a chance hit ends after the shortest of them.
    """

    def __init__(self, number: int | None, text: str, rate: float):
        self.number, self.text = number, text
        self.budget = int(len(text) * rate)
        count = self.budget + 1
        self.cuts = [len(text) * i // count for i in range(count + 1)]
        self.known = lru_cache(maxsize=None)(lambda a, b: masks(text[a:b]))

    def pieces(self) -> Iterator[tuple[str, int]]:
        for i in range(self.budget + 1):
            yield self.text[self.cuts[i]: self.cuts[i + 1]], i

    def confirm(self, piece: int, text: str, at: int) -> int | None:
        """The distance if the item stands around the place where piece number ``piece`` begins, else None."""
        path, low, high = [], 0, self.budget + 1
        while high - low > 1:
            path.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if piece < middle else (middle, high)
        distance = 0
        for low, high in reversed(path):
            a, b, allowed = self.cuts[low], self.cuts[high], high - low - 1
            begin = at - (self.cuts[piece] - a)
            distance = best_distance(self.known(a, b), b - a, text[max(0, begin - allowed): begin + (b - a) + allowed])
            if distance > allowed:
                return None
        return distance


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, rows: list[tuple[int | None, str | None]], rate: float):
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[Item, int]]] = {}
        for number, text in rows:
            if clean := normal(text):
                item = Item(number, clean, rate)
                for piece, i in item.pieces():
                    places.setdefault(piece, []).append((item, i))
        for piece, owners in places.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if places:
            self.automaton.make_automaton()
        self.some = bool(places)

    def found(self, text: str | None) -> dict[int | None, int]:
        """Item number to a distance within its budget, for every item in ``text``."""
        matched: dict[int | None, int] = {}
        if not self.some or not text:
            return matched
        clean = normal(text)
        for end, (size, owners) in self.automaton.iter(clean):
            for item, piece in owners:
                if item.number not in matched:
                    distance = item.confirm(piece, clean, end + 1 - size)
                    if distance is not None:
                        matched[item.number] = distance
        return matched


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The test set in blocks of about ``block_bytes`` of text each; one block at a time is on the driver."""
    items = benchmark.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    for block in range(count):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance: one row per document row and test item that it holds.

    An item is held when some substring of the lower-cased text with single spaces is within ``rate`` of the
    item's length in edits (insert, delete, replace a character); ``distance`` is that of the occurrence met first.
    Null or blank texts and items match nothing; an item id that repeats counts once per document. Empty tables give
    no rows; further columns are not looked at. The test set goes round in blocks of bounded size, the documents stay.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text")
    result = None
    for rows in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                where, items, distances = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for number, distance in matcher.found(text).items():
                        where.append(i)
                        items.append(number)
                        distances.append(distance)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(where, pa.int64())),
                        pa.array(items, pa.int64() if item_kind == "bigint" else None), pa.array(distances, pa.int32()),
                    ],
                    names=["doc_id", "item_id", "distance"],
                )

        part = slim.mapInArrow(searched, f"doc_id {kind}, item_id {item_kind}, distance int")
        result = part if result is None else result.union(part)
    return result


def contamination(docs: DataFrame, benchmark: DataFrame, *, rate: float = ERROR_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted). Rows that share an id share a finding.

    Test items are told apart by their ids; all items without one count as a single item, which is not among the ids.
    """
    found = leaks(docs, benchmark, rate=rate).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("item_id").isNull().cast("int")).alias("nameless")
    )
    renamed = found.select(F.col("doc_id").alias("__id"), "item_ids", "nameless")
    every = docs.select("doc_id").join(renamed, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    ids = F.coalesce("item_ids", F.expr(f"CAST(array() AS array<{benchmark.schema['item_id'].dataType.simpleString()}>)"))
    many = (F.size(ids) + F.coalesce("nameless", F.lit(0))).cast("long")
    return every.select("doc_id", (many > 0).alias("contaminated"), many.alias("n_items"), ids.alias("item_ids"))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; nothing is shuffled."""
    at = docs.columns.index("text")
    for rows in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.found(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
