"""Repeated passages: suffix automata of sharded reference passages, matching statistics, spans above a length removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliary.llm import blocks as B
from foliary.llm.words import Words, joined, mix, slices, windows

WINDOW = 20
ANCHOR = 5
# Where more different passages than this share an anchor, their windows are compared by hash instead, dealt to
# all shards: an exact way for anchors that a large part of the corpus shares.
CROWD = 512
BY_AUTOMATON, BY_WINDOW = 0, 1


class Block:
    """Words of the documents of a block, in the order of their ids, and their passages.

    A passage is a run of windows that share their anchor, the smallest hash of ANCHOR words inside them. Whatever
    document a window stands in, it belongs to a passage with the same anchor, so equal windows meet in one shard.
    """

    def __init__(self, table: pa.Table, window: int):
        texts = B.text_column(table).fill_null("")
        ids = np.array([-(1 << 63) if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        keys = texts.to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i]))
        self.order, self.ids = np.array(order, np.int64), ids[order]
        # Rows that repeat an id follow each other: their places are counted on, so that an order remains.
        self.offset = np.zeros(len(ids), np.int64)
        for i in range(1, len(ids)):
            if self.ids[i] == self.ids[i - 1]:
                self.offset[i] = self.offset[i - 1] + len(keys[order[i - 1]]) + 1
        self.parts = [Words(data, offsets) for _, _, data, offsets in slices(texts.take(pa.array(order)))]
        self.count = np.concatenate([p.count for p in self.parts])
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.word = np.concatenate([p.hashes() for p in self.parts])
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.starts = np.flatnonzero(windows(self.word, self.count, window))

    def passages(self, window: int):
        """anchor, content hash, first window, number of windows of every passage."""
        starts = self.starts
        if not len(starts):
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        grams = joined(self.word, ANCHOR)
        span = window - ANCHOR + 1
        least = grams.copy()
        place = np.arange(len(grams))
        best, at = least[: len(least) - span + 1].copy(), place[: len(place) - span + 1].copy()
        for shift in range(1, span):
            other = grams[shift: shift + len(best)]
            less = other < best
            best[less] = other[less]
            at[less] = place[shift: shift + len(best)][less]
        anchor, at = best[starts], at[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(starts)))
        whole = joined(self.word, window)
        begin = starts[head]
        content = mix(whole[begin] * np.uint64(3) + whole[begin + length - 1] * np.uint64(7) + length.astype(np.uint64))
        return anchor[head], content, begin, length

    def position(self, word: np.ndarray) -> np.ndarray:
        """Place of a word in the order of its document."""
        doc = self.doc[word]
        return word - self.first[doc] + self.offset[doc]

    def word_at(self, ids: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The inverse of ``position``."""
        left, right = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        doc = left.copy()
        for i in np.flatnonzero(right - left > 1):
            doc[i] = left[i] + np.searchsorted(self.offset[left[i]: right[i]], positions[i], "right") - 1
        return self.first[doc] + positions - self.offset[doc]


class Automaton:
    """Suffix automaton of passages added in the order of their first occurrence.

    ``met`` of a state is the earliest (order, end) at which its strings end. Passages come in rising order and a
    state keeps the first, so it is the earliest of all.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.met = [-1], [0], [None]

    def state(self, length: int, met, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        self.met.append(met)
        return len(self.length) - 1

    def add(self, last: int, symbol: int, met) -> int:
        """Follow ``last`` by ``symbol``; a string known already only moves on."""
        there = self.next[last].get(symbol)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self.split(last, there, symbol, met)
        new = self.state(self.length[last] + 1, met, {})
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][symbol]
            exact = self.length[there] == self.length[last] + 1
            self.link[new] = there if exact else self.split(last, there, symbol, met)
        return new

    def split(self, last: int, there: int, symbol: int, met) -> int:
        copy = self.state(self.length[last] + 1, self.met[there], dict(self.next[there]))
        self.link[copy], self.link[there] = self.link[there], copy
        while last >= 0 and self.next[last].get(symbol) == there:
            self.next[last][symbol] = copy
            last = self.link[last]
        return copy

    def walk(self, symbols, window: int):
        """Matching statistics: for each end of a window, where the window was met first."""
        at, matched = 0, 0
        for i, symbol in enumerate(symbols):
            while at and symbol not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if symbol in self.next[at]:
                at, matched = self.next[at][symbol], matched + 1
            while at and self.length[self.link[at]] >= window:
                at = self.link[at]
                matched = self.length[at]
            if matched >= window:
                yield i, self.met[at]


COPIES, ASKED, FOUND = 0, 1, 2
PLACES = pa.schema([
    ("block", pa.int32()), ("kind", pa.int32()), ("how", pa.binary()), ("ids", pa.binary()), ("places", pa.binary()),
    ("lengths", pa.binary()),
])
PLACES_SQL = "block int, kind int, how binary, ids binary, places binary, lengths binary"


def by_block(block: np.ndarray, kind: int, ids, places, lengths, how=None) -> list[dict]:
    """One packed row per block."""
    order = np.argsort(block, kind="stable")
    found = []
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        if len(part):
            found.append({
                "block": int(block[part[0]]), "kind": kind, "ids": B.packed(ids[part]), "places": B.packed(places[part]),
                "lengths": B.packed(lengths[part].astype(np.int32)), "how": B.packed(how[part]) if how is not None else b"",
            })
    return found


def unpacked(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows]) if rows else np.zeros(0, kind)


def blocks_of(rows: list[dict], name: str, size: int) -> np.ndarray:
    return np.repeat(np.array([r["block"] for r in rows], np.int64), [len(r[name]) // size for r in rows])


def crowd_windows(block: Block, rows: list[dict], window: int):
    """Windows of the passages asked for by hash: hash and word of the first of each in this block, words of the others."""
    how, ids = unpacked(rows, "how", np.uint8), unpacked(rows, "ids", np.int64)
    places, lengths = unpacked(rows, "places", np.int64), unpacked(rows, "lengths", np.int32)
    crowd = how == BY_WINDOW
    if not crowd.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = block.word_at(ids[crowd], places[crowd])
    lengths = lengths[crowd].astype(np.int64)
    starts = np.sort(np.repeat(begin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    hashes = joined(block.word, window)[starts]
    distinct, first = np.unique(hashes, return_index=True)
    again = np.ones(len(starts), bool)
    again[first] = False
    return distinct, starts[first], starts[again]


def kept_texts(block: Block, gone: np.ndarray) -> list[bytes]:
    """The words that stay, joined by one space, per document."""
    texts, base = [], 0
    for part in block.parts:
        stays = ~gone[base: base + len(part.start)]
        begin, size = part.start[stays], (part.end - part.start)[stays]
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        out[at + np.repeat(np.arange(len(size)), size)] = part.data[at + np.repeat(begin - before, size)]
        until = np.concatenate([[0], np.cumsum(size + 1)])
        edge = until[np.concatenate([[0], np.cumsum(stays)])[part.first]]
        texts += [out[a: max(a, b - 1)].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        base += len(part.start)
    return texts


def without_repeats(
    docs: DataFrame, window: int = WINDOW, *, crowd: int = CROWD, block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) for every row of ``docs``.

    A word goes when a window of ``window`` words around it, all in one document, also starts earlier: in a document of smaller
    id, or in the same one. Windows are judged on the input. Documents that share an id stand in the order of their
    texts; a null id comes first, and ids are whole numbers (others are refused). A null text has no words. An empty
    table gives no rows; further columns are not looked at.

    The reference, which is the corpus itself, is dealt to shards by content: windows that share an anchor form a passage, and equal
    windows always have equal anchors. Equal passages are one reference passage; where different passages share
    an anchor, their words go to the shard, which builds a suffix automaton of them in the order of their first
    occurrence and streams each through it. So a text meets only the part of the reference that could match it.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id has to be a whole number: the earlier of two equal passages is that of the smaller id")
    count, bits = B.sizes(docs, block_bytes=block_bytes)
    every = B.in_blocks(docs, count)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def dealt(table: pa.Table) -> pa.Table:
        block = Block(table, window)
        anchor, content, begin, length = block.passages(window)
        _, first = np.unique(content, return_index=True)
        first = first[np.argsort(anchor[first], kind="stable")]
        anchor, content, begin, length = anchor[first], content[first], begin[first], length[first]
        ids, places = block.ids[block.doc[begin]] if len(begin) else begin, block.position(begin) if len(begin) else begin
        cut = B.cut_points(anchor, bits)
        number = table.column("block")[0].as_py()
        return pa.Table.from_pylist([
            {
                "shard": s, "block": number, "anchors": B.packed(anchor[a:b]), "contents": B.packed(content[a:b]),
                "ids": B.packed(ids[a:b]), "places": B.packed(places[a:b]), "lengths": B.packed(length[a:b].astype(np.int32)),
            }
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a
        ], pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary()), ("contents", pa.binary()),
            ("ids", pa.binary()), ("places", pa.binary()), ("lengths", pa.binary()),
        ]))

    def compared(table: pa.Table) -> pa.Table:
        rows = B.rows_of(table)
        anchor, block = unpacked(rows, "anchors", np.uint64), blocks_of(rows, "anchors", 8)
        _, place, often = np.unique(anchor, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often[place] > 1)
        anchor, block = anchor[shared], block[shared]
        content, ids = unpacked(rows, "contents", np.uint64)[shared], unpacked(rows, "ids", np.int64)[shared]
        places, lengths = unpacked(rows, "places", np.int64)[shared], unpacked(rows, "lengths", np.int32)[shared]
        order = np.lexsort((places, ids, content, anchor))
        anchor, content, block = anchor[order], content[order], block[order]
        ids, places, lengths = ids[order], places[order], lengths[order]
        first = np.ones(len(order), bool)
        first[1:] = (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1])
        out = by_block(block[~first], COPIES, ids[~first], places[~first], lengths[~first])
        block, ids, places, lengths = block[first], ids[first], places[first], lengths[first]
        _, place, different = np.unique(anchor[first], return_inverse=True, return_counts=True)
        ask = different[place] > 1
        how = np.where(different[place] > crowd, BY_WINDOW, BY_AUTOMATON).astype(np.uint8)
        out += by_block(block[ask], ASKED, ids[ask], places[ask], lengths[ask], how[ask])
        return pa.Table.from_pylist(out, PLACES)

    def told(table: pa.Table, asked: pa.Table) -> pa.Table:
        rows = [r for r in B.rows_of(asked) if r["kind"] == ASKED]
        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("how", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()),
            ("places", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
        ])
        if not rows or not table.num_rows:
            return schema.empty_table()
        block = Block(table, window)
        number = table.column("block")[0].as_py()
        how, ids = unpacked(rows, "how", np.uint8), unpacked(rows, "ids", np.int64)
        places, lengths = unpacked(rows, "places", np.int64), unpacked(rows, "lengths", np.int32).astype(np.int64)
        out = []
        one = how == BY_AUTOMATON
        if one.any():
            anchor, _, begin, _ = block.passages(window)
            at = block.word_at(ids[one], places[one])
            key = anchor[np.searchsorted(begin, at)]
            order = np.argsort(key, kind="stable")
            key, at, own, where, length = key[order], at[order], ids[one][order], places[one][order], lengths[one][order]
            cut = B.cut_points(key, bits)
            for s in np.flatnonzero(np.diff(cut)):
                part = slice(cut[s], cut[s + 1])
                size = length[part] + window - 1
                word = np.repeat(at[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out.append({
                    "shard": int(s), "block": number, "how": BY_AUTOMATON, "keys": B.packed(key[part]), "ids": B.packed(own[part]),
                    "places": B.packed(where[part]), "lengths": B.packed(length[part]), "symbols": B.packed(block.word[word]),
                })
        hashes, starts, _ = crowd_windows(block, rows, window)
        cut = B.cut_points(hashes, bits)
        for s in np.flatnonzero(np.diff(cut)):
            part = starts[cut[s]: cut[s + 1]]
            out.append({
                "shard": int(s), "block": number, "how": BY_WINDOW, "keys": B.packed(hashes[cut[s]: cut[s + 1]]),
                "ids": B.packed(block.ids[block.doc[part]]), "places": B.packed(block.position(part)), "lengths": b"",
                "symbols": b"",
            })
        return pa.Table.from_pylist(out, schema)

    def matched(table: pa.Table) -> pa.Table:
        every_row = B.rows_of(table)
        rows = [r for r in every_row if r["how"] == BY_WINDOW]
        out = []
        if rows:
            key, block = unpacked(rows, "keys", np.uint64), blocks_of(rows, "keys", 8)
            ids, places = unpacked(rows, "ids", np.int64), unpacked(rows, "places", np.int64)
            order = np.lexsort((places, ids, key))
            again = order[1:][key[order][1:] == key[order][:-1]]
            out += by_block(block[again], FOUND, ids[again], places[again], np.ones(len(again), np.int32))
        rows = [r for r in every_row if r["how"] == BY_AUTOMATON]
        if rows:
            key, block = unpacked(rows, "keys", np.uint64), blocks_of(rows, "keys", 8)
            ids, places = unpacked(rows, "ids", np.int64), unpacked(rows, "places", np.int64)
            size = unpacked(rows, "lengths", np.int64) + window - 1
            symbols = unpacked(rows, "symbols", np.uint64).tolist()
            begin = (np.cumsum(size) - size).tolist()
            order = np.lexsort((places, ids, key))
            hits: list[tuple[int, int, int]] = []
            for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                passages = [
                    (int(ids[i]), int(places[i]), symbols[begin[i]: begin[i] + int(size[i])], int(block[i])) for i in group
                ]
                automaton = Automaton()
                for own, place, word, _ in passages:
                    last = 0
                    for i, symbol in enumerate(word):
                        last = automaton.add(last, symbol, (own, place + i))
                for own, place, word, number in passages:
                    hits += [
                        (number, own, place + i - window + 1) for i, met in automaton.walk(word, window) if met < (own, place + i)
                    ]
            if hits:
                found = np.array(hits, np.int64)
                out += by_block(found[:, 0], FOUND, found[:, 1].copy(), found[:, 2].copy(), np.ones(len(found), np.int32))
        return pa.Table.from_pylist(out, PLACES)

    id_type = docs.sparkSession.createDataFrame([], f"doc_id {kind}").toArrow().schema.field("doc_id").type

    def cleaned(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        if not table.num_rows:
            return schema.empty_table()
        block = Block(table, window)
        rows = B.rows_of(answers)
        told_of = [r for r in rows if r["kind"] != ASKED]
        begin = block.word_at(unpacked(told_of, "ids", np.int64), unpacked(told_of, "places", np.int64))
        length = unpacked(told_of, "lengths", np.int32).astype(np.int64)
        _, content, own_begin, own_length = block.passages(window)
        _, first = np.unique(content, return_index=True)
        again = np.ones(len(content), bool)
        again[first] = False
        _, _, later = crowd_windows(block, [r for r in rows if r["kind"] == ASKED], window)
        begin = np.concatenate([begin, own_begin[again], later])
        length = np.concatenate([length, own_length[again], np.ones(len(later), np.int64)])
        change = np.zeros(len(block.word) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + length + window - 1, -1)
        gone = np.cumsum(change)[:-1] > 0
        removed = np.bincount(block.doc[gone], minlength=len(block.count))
        return pa.Table.from_arrays([
            table.column("doc_id").combine_chunks().take(pa.array(block.order)), pa.array(block.count.astype(np.int64)),
            pa.array(removed.astype(np.int64)), pa.array(kept_texts(block, gone), pa.binary()).cast(pa.string()),
        ], schema=schema)

    passages = B.per_group(
        every, "block", dealt,
        "shard int, block int, anchors binary, contents binary, ids binary, places binary, lengths binary",
    )
    replies = B.per_group(passages, "shard", compared, PLACES_SQL)
    words = every.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        told,
        "shard int, block int, how int, keys binary, ids binary, places binary, lengths binary, symbols binary",
    )
    found = B.per_group(words, "shard", matched, PLACES_SQL)
    return every.groupBy("block").cogroup(replies.union(found).groupBy("block")).applyInArrow(
        cleaned, f"doc_id {kind}, n_words long, n_removed long, kept string"
    )
