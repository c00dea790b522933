"""Documents packed into windows of tokens: each seed is joined by the unused neighbours that a BM25 index returns."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.words import mix
from foliary.session import new_folder

WINDOW = 2048
END_ID = 1
VOCABULARY = 1 << 16
# Tokens in one shard of the index, neighbours in the first batch of a ranking. A term
# that more than one in COMMON tails of the shard have is held as a row of weights.
SHARD_TOKENS = 2_000_000
NEIGHBOURS = 16
COMMON = 8
K1, LENGTH_WEIGHT = 1.2, 0.75
TEXT_SLICE = 2 << 20

# How the byte-level kind of tokenizer file parts a text (a fixed value of the format).
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_slices(column: pa.Array, limit: int = TEXT_SLICE) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of whole texts of about ``limit`` characters. A null is an empty text."""
    held: list[str] = []
    first = size = 0
    for value in column.cast(pa.large_binary()):
        raw = value.as_py() or b""
        held.append(raw.decode("utf-8", "replace"))
        size += len(raw)
        if size >= limit:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def plain_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of every token and its id, where the file is plain byte-level BPE whose ids follow its merges; else None."""
    file = json.loads(Path(path).read_text("utf-8"))
    model, parts = file["model"], file["pre_tokenizer"] or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    merged = [first + second for first, second in (m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ()))]
    vocabulary = model.get("vocab", {})
    fits = (
        model["type"] == "BPE" and not any(model.get(o) for o in options) and file["normalizer"] is None
        and parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space", True)
        and all(vocabulary.get(m) == 256 + i for i, m in enumerate(merged)) and len(vocabulary) >= 256 + len(merged)
    )
    if not fits:
        return None
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in file["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class Encoder:
    """Ids of texts as the tokenizer of a file gives them.

    For the plain byte-level kind a second implementation of the same merges does the work at a multiple of the speed; it is
    told nothing of added tokens, so texts that hold one go through the tokenizer itself, as do files of any other kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > VOCABULARY:
            raise ValueError(f"{path} has more than {VOCABULARY} tokens")
        ranks = plain_ranks(path)
        self.quick = None
        if ranks:
            import tiktoken

            self.quick = tiktoken.Encoding("plain", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.frombuffer(array("H", self.quick.encode_ordinary(text)), np.uint16)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def check_sum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of kind ``full`` (pieces that fill a window), ``tail`` (what is left of a document) and ``terms`` (document counts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    layout = f"kind string, doc_id {kind}, start long, length long, crc long, doc_tokens long, sequence_id long, near long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        counts = np.zeros(VOCABULARY, np.int64)
        sequence = TaskContext.get().partitionId() << 40
        id_type = None
        spread = mix(np.arange(VOCABULARY, dtype=np.uint64) + np.uint64(99))
        for batch in batches:
            id_type = batch.schema.field(0).type
            for row, texts in text_slices(batch.column(1)):
                out: list[tuple] = []
                for i, text in enumerate(texts):
                    ids = np.append(encode.ids(text), np.uint16(END_ID))
                    total = len(ids)
                    for start in range(0, total - WINDOW + 1, WINDOW):
                        out.append(("full", row + i, start, WINDOW, check_sum(ids[start: start + WINDOW]), total, 2 * sequence, 0, b""))
                        sequence += 1
                    start = total // WINDOW * WINDOW
                    if start < total:
                        tail = ids[start:]
                        terms = np.unique(tail)
                        counts[terms] += 1
                        near = int(spread[terms].min() >> np.uint64(1))
                        out.append(("tail", row + i, start, total - start, 0, total, 0, near, tail.tobytes()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.string()), batch.column(0).take(pa.array(columns[1], pa.int64())),
                        *[pa.array(c, pa.int64()) for c in columns[2:8]], pa.array(columns[8], pa.binary()),
                    ],
                    names=["kind", "doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "near", "ids"],
                )
        if id_type is not None:
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["terms"]), pa.nulls(1, id_type), *[pa.array([0], pa.int64())] * 6,
                    pa.array([np.stack([used, counts[used]]).tobytes()], pa.binary()),
                ],
                names=["kind", "doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "near", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, layout)


def document_counts(rows: DataFrame) -> np.ndarray:
    """In how many tails each token id stands, over all of them: one number per id of the vocabulary."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids, counts = np.frombuffer(blob, np.int64).reshape(2, -1)
                total[ids] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = rows.where("kind = 'terms'").select("ids").mapInArrow(opened, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(VOCABULARY, np.int64)
    for r in found.collect():  # at most one row per id of the vocabulary
        counts[r["id"]] = r["n"]
    return counts


class Index:
    """Inverted index of one shard of tails, with BM25 weights worked out from the counts of the whole corpus."""

    def __init__(self, tails: list[np.ndarray], rarity: np.ndarray, mean_length: float):
        sizes = np.array([len(t) for t in tails])
        owner = np.repeat(np.arange(len(tails)), sizes)
        cell, count = np.unique(owner * VOCABULARY + np.concatenate(tails), return_counts=True)
        self.owner, self.term = cell // VOCABULARY, cell % VOCABULARY
        scale = K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * sizes / mean_length)
        self.weight = rarity[self.term] * count * (K1 + 1) / (count + scale[self.owner])
        self.first = np.searchsorted(self.owner, np.arange(len(tails) + 1))
        order = np.argsort(self.term, kind="stable")
        self.by_owner, self.by_weight = self.owner[order], self.weight[order]
        self.postings = np.searchsorted(self.term[order], np.arange(VOCABULARY + 1))
        self.size = len(tails)
        common = np.flatnonzero(np.diff(self.postings) > max(1, self.size // COMMON))
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.size), np.float32)
        for row, t in zip(self.rows, common, strict=True):
            part = slice(self.postings[t], self.postings[t + 1])
            row[self.by_owner[part]] = self.by_weight[part]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed; the end mark is no term."""
        terms = self.term[self.first[seed]: self.first[seed + 1]]
        terms = terms[terms != END_ID]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        spans = [slice(self.postings[t], self.postings[t + 1]) for t in terms[row < 0]]
        if spans:
            owners, weights = [self.by_owner[s] for s in spans], [self.by_weight[s] for s in spans]
            score += np.bincount(np.concatenate(owners), np.concatenate(weights), self.size)
        return score

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[np.ndarray]:
        """All unused documents with a score above 0, by falling score, in batches that grow."""
        score = self.scores(seed)
        score[used] = 0
        left = np.flatnonzero(score > 0)
        many = NEIGHBOURS
        while len(left):
            if len(left) > many:
                split = np.argpartition(-score[left], many)
                top, left = left[split[:many]], left[split[many:]]
            else:
                top, left = left, left[:0]
            yield top[np.lexsort((top, -score[top]))]
            many *= 4


def packed(tails: list[np.ndarray], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(tail, from, length, sequence, offset): every seed with its neighbours fills a window, the last of them cut to fit.

    A seed's ranking is followed to its end. Only when no unused document with a term in common is left, the longest
    unused ones fill the window. Seeds go from the longest to the shortest. The rest of a cut document stays in the index for later seeds.
    """
    length = np.array([len(t) for t in tails])
    done = np.zeros(len(tails), np.int64)
    used = np.zeros(len(tails), bool)
    order = np.argsort(-length, kind="stable")
    following = 0
    sequence = 0
    for seed in order:
        if used[seed]:
            continue
        filled = 0

        def put(tail: int, most: int) -> tuple[int, int, int, int, int]:
            size = min(int(length[tail] - done[tail]), most)
            piece = (tail, int(done[tail]), size, sequence, filled)
            done[tail] += size
            used[tail] = done[tail] == length[tail]
            return piece

        piece = put(int(seed), WINDOW)
        filled += piece[2]
        yield piece
        for near in index.neighbours(int(seed), used) if filled < WINDOW else ():
            for fits in (True, False):
                for tail in near:
                    if filled < WINDOW and not used[tail] and (not fits or length[tail] - done[tail] <= WINDOW - filled):
                        piece = put(int(tail), WINDOW - filled)
                        filled += piece[2]
                        yield piece
            if filled == WINDOW:
                break
        while filled < WINDOW and following < len(order):
            if used[order[following]]:
                following += 1
                continue
            piece = put(int(order[following]), WINDOW - filled)
            filled += piece[2]
            yield piece
        sequence += 1


def pack(docs: DataFrame, *, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, for all of (doc_id, text).

    A document is its ids and END_ID; a null or empty text has END_ID alone. Whole windows of a document stand
    alone, and what is left of it is packed: sorted by their smallest hashed term, tails go to shards of about ``shard_tokens``
    tokens, each with an inverted index of its own and the document counts of the whole corpus. A shard leaves at most
    one window unfilled. Repeated rows are packed each; an empty table gives no rows; further columns are not
    looked at. ``tokenizer`` is the path of a file that every executor has.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    folder = new_folder(spark, "packing")
    coded = encoded(docs, path)
    coded.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(coded.schema).parquet(folder)
    tails = rows.where("kind = 'tail'")
    counts = document_counts(rows)
    total = tails.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
    n, tokens = total["n"], total["tokens"] or 0
    rarity = np.log1p((n - counts + 0.5) / (counts + 0.5))
    shared = spark.sparkContext.broadcast((rarity.astype(np.float32), tokens / max(n, 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, mean_length = shared.value
        sequence = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            nonlocal sequence
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = [np.frombuffer(b, np.uint16) for b in table.column("ids").to_pylist()]
            pieces = list(packed(ids, Index(ids, rarity, mean_length)))
            which, begin, length, number, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            sums = [check_sum(ids[w][b: b + s]) for w, b, s in zip(which, begin, length, strict=True)]
            start = np.asarray(table.column("start").to_numpy())[which] + begin
            out = pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks().take(pa.array(which)), pa.array(start), pa.array(length),
                    pa.array(sums, pa.int64()), pa.array(np.asarray(table.column("doc_tokens").to_numpy())[which]),
                    pa.array(2 * (sequence + number) + 1), pa.array(offset),
                ],
                names=columns,
            )
            sequence += int(number[-1]) + 1
            return out

        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(2).to_numpy(zero_copy_only=False)))
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                to = min(batch.num_rows, int(np.searchsorted(ends, before + shard_tokens - size)) + 1)
                held.append(batch.slice(begin, to - begin))
                size += int(ends[to - 1] - before)
                begin = to
                if size >= shard_tokens:
                    yield flushed()
                    size = 0
        if held:
            yield flushed()

    layout = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    shards = max(1, -(-tokens // shard_tokens))
    spread = tails.select("doc_id", "start", "length", "doc_tokens", "near", "ids").repartitionByRange(shards, "near", "doc_id")
    filled = spread.sortWithinPartitions("near", "doc_id", "doc_tokens").mapInArrow(run, layout)
    whole = rows.where("kind = 'full'").select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")
    )
    return whole.union(filled)
