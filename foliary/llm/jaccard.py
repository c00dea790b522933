"""Documents linked by the Jaccard similarity of their word n-grams, exactly, and the groups that the links make."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import blocks as B
from foliary.llm.components import components
from foliary.llm.words import Words, joined, mix, slices
from foliary.operators.keyfilter import key_filter, may_contain
from foliary.session import staged

# Defaults: links at 100 * intersection >= 90 * union. Then the sets differ in at most (n + m) / 19 elements.
SHINGLE = 3
PERCENT = 90
SPARE = 2
BATCH_ENTRIES = 1 << 20
FAMILY_CHUNK = 512
SEGMENT = 32
# Bits of a sketch per element, and at all, at least; sketches are compared in chunks of so many bytes, or so many of the largest.
SKETCH_BITS = 2
LEAST_BITS = 256
SKETCH_CHUNK = 1 << 20
SKETCHES = 64


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes per text, a slice of texts at a time.

    A text of fewer words than a shingle has one element, its whole sequence; a text without words has none.
    """
    for row, _, data, offsets in slices(texts):
        words = Words(data, offsets)
        hashes = words.hashes(lower=True)
        grams = joined(hashes, shingle)
        found = []
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= shingle:
                found.append(np.unique(grams[a: b - shingle + 1]))
            else:
                found.append(joined(np.append(hashes[a:b], np.uint64(b - a)), b - a + 1)[:1] if b > a else np.zeros(0, np.uint64))
        yield row, found


def set_digest(values: np.ndarray) -> int:
    total = mix(values).sum(dtype=np.uint64) + np.uint64(len(values))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(values: np.ndarray) -> np.ndarray:
    """For each of a power of two of bits whether the elements dealt to it are odd in number.

    Two sets differ in at least as many elements as their sketches differ in bits, also after both were folded to fewer words.
    """
    bits = max(LEAST_BITS, 1 << (SKETCH_BITS * len(values) - 1).bit_length())
    place = (mix(values ^ np.uint64(0x3C3C3C3C)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(bool), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches, word by word, as they are with ``size`` words."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2:]
    return words


def class_tops() -> list[int]:
    """Largest set size of each size class; a class is half as large again as the one before."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * 3 // 2))
    return tops


TOPS = class_tops()


def differing(n: int, top: int, percent: int) -> int:
    """In how many elements a set of ``n`` and one linked to it can differ, if that has at most ``top``."""
    return (n + min(top, n * 100 // percent)) * (100 - percent) // (100 + percent)


def part_count(top: int, percent: int = PERCENT) -> int:
    """Parts for sets of at most ``top`` elements: more than the elements in which linked sets may differ, by 1 and spare ones.

    There are more spare parts the fewer elements a part has, so that parts of none or one need not be used.
    """
    most = 2 * top * (100 - percent) // (100 + percent)
    mean = (100 + percent) / (2 * (100 - percent))
    return most + 1 + SPARE + int(2 * most * (1 + mean) * math.exp(-mean))


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set), such that linked sets have one in common.

    The elements are dealt to parts by hash, and a signature is the hash of a part, empty or not. A set that can differ from a
    linked one in d elements agrees with it in all parts but d, so it gives d + 1 signatures: the last ones in an order
    that all sets share, by the number of elements of the part and then by hash. Of the parts in which two linked sets agree,
    neither can have left out all, since the one that leaves out more of them leaves out fewer than there are. A set takes
    part in its size class and in those up to the class of the largest set that can be linked to it.
    """
    codes, owners = [], []
    sizes = np.array([len(s) for s in sets])
    for number in np.flatnonzero(sizes):
        values, n = sets[number], int(sizes[number])
        spread = mix(values ^ np.uint64(0xA5A5A5A5))
        for at in range(bisect_left(TOPS, n), bisect_left(TOPS, n * 100 // percent) + 1):
            parts = part_count(TOPS[at], percent)
            part = (((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(parts, np.uint64)
            np.add.at(total, part, spread)
            code = mix(total + mix(np.arange(parts, dtype=np.uint64) + np.uint64(at << 40)))
            heavy = np.lexsort((code, np.bincount(part, minlength=parts)))
            codes.append(code[heavy[-1 - differing(n, TOPS[at], percent):]])
            owners.append(np.full(len(codes[-1]), number))
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


def stars(codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order with their smallest owner, and distinct pairs of it with the other owners."""
    order = np.lexsort((owners, codes))
    codes, owners = codes[order], owners[order]
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    centre = owners[first][np.cumsum(first) - 1]
    other = owners != centre
    pairs = np.unique(np.stack([centre[other], owners[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return codes[first], owners[first], pairs[:, 0].copy(), pairs[:, 1].copy()


class Trie:
    """Sets in one global order of elements, with shared beginnings stored once, as runs of at most SEGMENT elements."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.run, self.kids, self.ends, self.low, self.high = [np.zeros(0, np.int64)], [{}], [[]], [1 << 60], [0]
        self.members: list[list[int]] = [[]]

    def node(self, run: np.ndarray) -> int:
        self.run.append(run)
        self.kids.append({})
        self.ends.append([])
        self.low.append(1 << 60)
        self.high.append(0)
        self.members.append([])
        return len(self.run) - 1

    def add(self, number: int, values: np.ndarray) -> None:
        at, done = 0, 0
        while True:
            self.low[at], self.high[at] = min(self.low[at], len(values)), max(self.high[at], len(values))
            self.members[at].append(number)
            if done == len(values):
                self.ends[at].append(number)
                return
            key = int(values[done])
            kid = self.kids[at].get(key)
            if kid is None:
                kid = self.kids[at][key] = self.node(values[done: done + SEGMENT])
            run = self.run[kid]
            here = values[done: done + len(run)]
            same = len(run) if len(here) == len(run) and (here == run).all() else int(
                np.argmin(np.append(here == run[: len(here)], False))
            )
            if same < len(run):
                upper = self.node(run[:same])
                self.low[upper], self.high[upper] = self.low[kid], self.high[kid]
                self.members[upper] = list(self.members[kid])
                self.run[kid] = run[same:]
                self.kids[upper][int(run[same])] = kid
                self.kids[at][key] = upper
                kid = upper
            at, done = kid, done + same

    def linked(self, values: np.ndarray, mark: np.ndarray, settled) -> Iterator[int]:
        """Numbers of sets linked to ``values`` (marked in ``mark``).

        A subtree is left when even all that remains of both sides would not make a link, or when all of it is settled.
        """
        n = len(values)
        todo = [(0, 0, 0)]
        while todo:
            at, depth, common = todo.pop()
            run = self.run[at]
            if len(run):
                common += int(mark[run].sum())
                depth += len(run)
                rest = n - int(np.searchsorted(values, run[-1], "right"))
            else:
                rest = n
            for number in self.ends[at]:
                if 100 * common >= self.percent * (n + depth - common):
                    yield number
            best = common + min(rest, self.high[at] - depth)
            # The union is smallest for the smallest set below.
            if 100 * best < self.percent * (n + max(self.low[at], best) - best) or settled(self.members[at]):
                continue
            todo += [(kid, depth, common) for kid in self.kids[at].values()]


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all linked sets of ``left`` (or of ``left`` with ``right``, numbered on), without circles."""
    every = left + (right or [])
    owner = list(range(len(every)))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    vocabulary, place = np.unique(np.concatenate(every), return_inverse=True)
    ranks = np.split(place, np.cumsum([len(s) for s in every])[:-1])
    mark = np.zeros(len(vocabulary), bool)
    trie, found = Trie(percent), []
    if right is not None:
        for i in range(len(left)):
            trie.add(i, ranks[i])
    for i in range(0 if right is None else len(left), len(every)):
        mark[ranks[i]] = True
        own = i

        def settled(numbers: list[int], own=own) -> bool:
            mine = root(own)
            return all(root(j) == mine for j in numbers)

        for j in trie.linked(ranks[i], mark, settled):
            if root(i) != root(j):
                owner[root(j)] = root(i)
                found.append((j, i))
        mark[ranks[i]] = False
        if right is None:
            trie.add(i, ranks[i])
    return found


def alike(sizes: np.ndarray, words: np.ndarray, split: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs without circles that connect all sets whose sketches do not tell that they are not linked.

    A column of ``words`` is the sketch of a set; the sets are in order of size, up to ``split`` and from there on. Each one before
    ``split`` is compared with those from it on, and if there are none, with each other.
    """
    coarse, found = folded(words, max(1, len(words) // 2)), []
    owner = np.arange(len(sizes))
    across = split < len(sizes)
    others = sizes[split:] if across else sizes

    def roots(numbers: np.ndarray) -> np.ndarray:
        at = owner[numbers]
        while (owner[at] != at).any():
            at = owner[at]
        owner[numbers] = at
        return at

    for i in range(split):
        n = int(sizes[i])
        begin = split + int(np.searchsorted(others, -(-n * percent // 100))) if across else i + 1
        end = (split if across else 0) + int(np.searchsorted(others, n * 100 // percent, "right"))
        # Linked sets differ in so many elements at most.
        most = (n + sizes[begin:end]) * (100 - percent) // (100 + percent)
        apart = np.zeros(end - begin, np.uint32)
        for row in coarse:
            apart += np.bitwise_count(row[begin:end] ^ row[i])
        near = begin + np.flatnonzero(apart <= most)
        apart = np.bitwise_count(words[:, near] ^ words[:, i: i + 1]).sum(axis=0, dtype=np.int64)
        near = near[apart <= most[near - begin]]
        tops = roots(near)
        mine = int(roots(np.array([i]))[0])
        tops, first = np.unique(tops, return_index=True)
        found += [(i, int(near[at])) for top, at in zip(tops, first, strict=True) if top != mine]
        owner[tops] = mine
    return found


def set_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its sketch, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([B.packed(sketch(s)) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {kind}, n_shingles long, digest long, sketch binary")


def candidates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of set digests with a signature in common, as stars: each code ties its sets to one of them.

    Codes are dealt to shards by their upper bits, as many shards as the bytes of text ask for.
    """
    _, bits = B.sizes(docs)
    layout = pa.schema([("shard", pa.int32()), ("codes", pa.binary()), ("owners", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            codes, owners, a, b = stars(np.concatenate([c for c, _ in held]), np.concatenate([o for _, o in held]))
            held.clear()
            cut = B.cut_points(codes, bits)
            share = np.array_split(np.arange(len(a)), 1 << bits)
            return pa.RecordBatch.from_pylist([
                {
                    "shard": s, "codes": B.packed(codes[cut[s]: cut[s + 1]]), "owners": B.packed(owners[cut[s]: cut[s + 1]]),
                    "a": B.packed(a[share[s]]), "b": B.packed(b[share[s]]),
                }
                for s in range(1 << bits)
            ], layout)

        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), shingle):
                codes, owners = signatures(sets, percent)
                held.append((codes, np.array([set_digest(s) for s in sets], np.int64)[owners]))
                if sum(len(c) for c, _ in held) > BATCH_ENTRIES:
                    yield flushed()
        if held:
            yield flushed()

    def tied(table: pa.Table) -> pa.Table:
        rows = B.rows_of(table)
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        _, _, a, b = stars(read("codes", np.uint64), read("owners", np.int64))
        pairs = np.unique(
            np.stack([np.concatenate([a, read("a", np.int64)]), np.concatenate([b, read("b", np.int64)])], axis=1), axis=0
        )
        return pa.table({"a": pa.array(pairs[:, 0].copy(), pa.int64()), "b": pa.array(pairs[:, 1].copy(), pa.int64())})

    dealt = docs.select("text").mapInArrow(asked, "shard int, codes binary, owners binary, a binary, b binary")
    return B.per_group(dealt, "shard", tied, "a long, b long")


def in_pairs(chunked: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows with a ``chunk`` of ``chunks`` of their group, once for every pair (low, high) of chunks that theirs is one of."""
    return chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *group, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", *columns
    )


def narrowed(family: DataFrame, every: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) with every family of more than FAMILY_CHUNK sets divided into those that sketches leave.

    Texts that have a line in common agree in a part by chance, the more of them the larger the corpus, and chance ties
    families to each other. Sets of a family are compared by their sketches, which are a small part of the sets, within the
    size class of the larger one, in chunks of about SKETCH_CHUNK bytes. A linked pair stays together, and a set that is like no
    other one leaves.
    """
    large = staged(
        family.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > FAMILY_CHUNK)
        .select(F.col("component").alias("family")), "shingle-large"
    )
    if large.isEmpty():
        return family
    inside = staged(family.join(large, family["component"] == large["family"]).select("node", "family"), "shingle-inside")
    slim = may_contain(every.select("digest", "n_shingles", "sketch"), key_filter(inside.select("node")), [F.col("digest")], "__inside")
    members = slim.where("__inside").join(inside, F.col("digest") == inside["node"]).dropDuplicates(["digest"])

    def in_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            spans = [range(bisect_left(TOPS, n), bisect_left(TOPS, n * 100 // percent) + 1) for n in sizes]
            rows = pa.array([row for row, span in enumerate(spans) for _ in span], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(rows) for c in batch.columns], pa.array([at for span in spans for at in span], pa.int32())],
                names=[*batch.schema.names, "class"],
            )

    dealt = staged(
        members.select("family", "digest", "n_shingles", "sketch").mapInArrow(
            in_classes, "family long, digest long, n_shingles long, sketch binary, class int"
        ), "shingle-sketches",
    )
    size = F.octet_length("sketch")
    chunks = dealt.groupBy("family", "class").agg(
        F.ceil(F.sum(size) / F.greatest(F.lit(SKETCH_CHUNK), SKETCHES * F.max(size))).cast("int").alias("chunks")
    )
    chunked = dealt.join(chunks, ["family", "class"]).withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))

    def compared(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("n_shingles", "ascending"), ("digest", "ascending")])
        chunk, digest = (table.column(c).to_numpy() for c in ("chunk", "digest"))
        sketches = [np.frombuffer(b, "<u8") for b in table.column("sketch").to_pylist()]
        size = min(len(s) for s in sketches)
        words = np.ascontiguousarray(np.stack([folded(s, size) for s in sketches], axis=1))
        split = int((chunk == table.column("low")[0].as_py()).sum())
        both = table.column("low")[0].as_py() == table.column("high")[0].as_py() or 0 < split < len(sketches)
        links = alike(table.column("n_shingles").to_numpy(), words, split, percent) if both else []
        return pa.table({
            "a": pa.array([int(digest[i]) for i, _ in links], pa.int64()), "b": pa.array([int(digest[j]) for _, j in links], pa.int64()),
        })

    links = in_pairs(chunked, ["family", "class"], ["digest", "n_shingles", "sketch"]).groupBy("family", "class", "low", "high")
    parts = staged(components(links.applyInArrow(compared, "a long, b long")), "shingle-parts")
    small = family.join(large, family["component"] == large["family"], "left_anti")
    return small.select("node", "component").union(parts.select("node", "component"))


def verified(texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between digests, from (digest, family, chunks, text): one text per set that has a candidate.

    A family is compared in chunks of about FAMILY_CHUNK sets, every chunk with itself and with every other, so a task holds
    two chunks however large the family. A task gives links without circles, fewer than it has sets.
    """

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_pylist()
            for row, sets in shingle_sets(batch.column(3), shingle):
                # An id may stand on several rows; only the text that has the set counts.
                right = pa.array([set_digest(s) == asked[row + i] for i, s in enumerate(sets)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(row, len(sets)) for i in range(3)], pa.array([B.packed(s) for s in sets], pa.binary())],
                    names=["digest", "family", "chunks", "elements"],
                ).filter(right)

    sets = texts.select("digest", "family", "chunks", "text").mapInArrow(
        as_sets, "digest long, family long, chunks int, elements binary"
    ).withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    paired = in_pairs(sets, ["family"], ["digest", "elements"])

    def compared(table: pa.Table) -> pa.Table:
        rows = sorted(B.rows_of(table), key=lambda r: (r["chunk"], len(r["elements"]), r["digest"]))
        arrays = [np.frombuffer(r["elements"], np.uint64) for r in rows]
        split = sum(r["chunk"] == rows[0]["low"] for r in rows)
        if rows[0]["low"] == rows[0]["high"]:
            links = forest(arrays, None, percent)
        else:
            links = forest(arrays[:split], arrays[split:], percent) if 0 < split < len(rows) else []
        return pa.table({
            "a": pa.array([rows[i]["digest"] for i, _ in links], pa.int64()),
            "b": pa.array([rows[j]["digest"] for _, j in links], pa.int64()),
        })

    return paired.groupBy("family", "low", "high").applyInArrow(compared, "a long, b long")


def similar_groups(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text).

    Sets of distinct shingles of ``shingle`` words with A-Z lower-cased; fewer words make one shingle. Documents are linked when
    100 times the intersection is at least ``percent`` times the union, and empty sets never. ``component_id`` is the smallest id that
    links reach; rows that share an id are judged each by its own text. A row without an id keeps a null component unless
    it is linked to one with an id. An empty table gives no rows; further columns are not looked at.

    1. Equal sets fall together by size and digest, with a native aggregate.
    2. Sets that agree in a part of their elements are candidates, and joined candidates a family. No linked pair is
       missed (see ``signatures``). A large family, which may be held together by chance, is divided (see ``narrowed``).
    3. Within a family, sets in one global order are stored in a trie and looked up in it.
    4. Families and the resulting components are found by star joins.
    """
    every = staged(set_table(docs, shingle), "shingle-sets")
    classes = staged(
        every.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("keeper")), "shingle-classes"
    )
    family = narrowed(staged(components(candidates(docs, shingle, percent)), "shingle-families"), every, percent)
    chunks = family.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / FAMILY_CHUNK).cast("int").alias("chunks"))
    wanted = staged(
        family.join(chunks, "component").join(classes, family["node"] == classes["digest"])
        .select("digest", F.col("component").alias("family"), "chunks", F.col("keeper").alias("__keeper")),
        "shingle-wanted",
    )
    # Texts that no family wants are told apart by a bit table and enter no exchange.
    bits = key_filter(wanted.select("__keeper"))
    slim = may_contain(docs.select("doc_id", "text"), bits, [F.col("doc_id")], "__wanted").where("__wanted").drop("__wanted")
    texts = slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["__keeper"])).select("digest", "family", "chunks", "text")
    return labelled(every, classes, components(verified(texts, shingle, percent)))


def labelled(every: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    joined_groups = groups.join(classes, groups["node"] == classes["digest"]).select("digest", "component", "keeper")
    smallest = joined_groups.groupBy("component").agg(F.min("keeper").alias("smallest"))
    linked = staged(
        joined_groups.join(smallest, "component").select(F.col("digest").alias("__d"), "smallest"), "shingle-labels"
    )
    named = staged(
        classes.join(linked, classes["digest"] == F.col("__d"), "left")
        .select(F.col("digest").alias("__digest"), F.coalesce("smallest", "keeper").alias("label")),
        "shingle-names",
    )
    # Empty sets have no class; a key of their own keeps them apart.
    key = F.when(F.col("n_shingles") > 0, F.col("digest")).otherwise(F.xxhash64(F.lit("alone"), "doc_id"))
    keyed = every.withColumn("__key", key)
    return keyed.join(named, (F.col("__key") == F.col("__digest")) & (F.col("n_shingles") > 0), "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, with all columns; an id that repeats stays if one row does."""
    groups = similar_groups(docs, shingle=shingle, percent=percent)
    gone = (
        groups.groupBy("doc_id").agg(F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("stays"))
        .where(~F.col("stays")).select(F.col("doc_id").alias("__gone"))
    )
    gone = staged(gone, "shingle-gone")
    # Rows that certainly stay are told apart by a bit table, so only the texts of the others may enter an exchange.
    rows = docs.select(F.col("doc_id").alias("__id"), F.struct("*").alias("__row"))
    flagged = may_contain(rows, key_filter(gone), [F.col("__id")], "__doubtful")
    doubtful = flagged.where("__doubtful").join(gone, F.col("__id").eqNullSafe(F.col("__gone")), "left_anti")
    return flagged.where(~F.col("__doubtful")).select("__row.*").union(doubtful.select("__row.*"))
