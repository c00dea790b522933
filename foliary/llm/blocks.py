"""Documents in blocks of bounded size, and packed arrays between blocks and shards of keys.

A block asks about each of its keys once, in sorted order, one packed row per shard; the shards answer in that order.
So a key that fills a third of a table costs one entry per block, and no group grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
# Keys are dealt to a power of two of shards by their upper bits.
MIN_SHARD_BITS = 6
SHARD_BYTES = 32 << 20


def sizes(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[int, int]:
    """Number of blocks, and bits of the number of shards, for the bytes of text in ``docs``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes)), max(MIN_SHARD_BITS, (total // shard_bytes).bit_length())


def in_blocks(docs: DataFrame, blocks: int, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(block, doc_id, text); rows alike in ``by`` share a block. Column names of ``docs`` beyond these do not matter."""
    return docs.select(
        F.pmod(F.xxhash64(F.lit("block"), *by), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text"
    )


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def pack_small(values: np.ndarray, kind=np.uint8) -> bytes:
    """Whole numbers that nearly all fit ``kind``: those as such, and the others beside them with their places."""
    most = np.iinfo(kind).max
    large = np.flatnonzero(values >= most)
    head = np.array([len(values), len(large)], np.int64)
    return b"".join((
        head.tobytes(), np.minimum(values, most).astype(kind).tobytes(), large.astype(np.int64).tobytes(),
        values[large].astype(np.int64).tobytes(),
    ))


def unpack_small(data: bytes, kind=np.uint8) -> np.ndarray:
    size, large = np.frombuffer(data, np.int64, 2)
    values = np.frombuffer(data, kind, size, 16).astype(np.int64)
    rest = np.frombuffer(data[16 + int(size) * np.dtype(kind).itemsize:], np.int64)
    values[rest[:large]] = rest[large:]
    return values


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising numbers below 2^63 by their steps, which are short where there are many."""
    return pack_small(np.diff(keys.astype(np.int64), prepend=0), np.uint32)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_small(data, np.uint32)).astype(np.uint64)


def cut_points(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the keys of each shard begin in the sorted ``keys``; one entry more than shards."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def rows_of(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def text_column(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def per_group(df: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy(key).applyInArrow(run, schema)
