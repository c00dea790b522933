"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)
# Words up to so many bytes are hashed side by side, eight bytes at a time; longer ones each by a digest.
SHORT = 64
# Odd factors without a pattern, one per place of a run of words.
FACTORS = np.random.default_rng(17).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(value: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


class Words:
    """Words of a slice of texts. ``first[d]`` to ``first[d + 1]`` are the words of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~SPACE[data]
        starts, ends = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        full = offsets[1:] > offsets[:-1]
        begin, end = offsets[:-1][full], offsets[1:][full] - 1
        starts[begin] = solid[begin]
        ends[end] = solid[end]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of every word. Every eight bytes are mixed in before the next, so no pattern of letters cancels out."""
        data = TO_LOWER[self.data] if lower else self.data
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        # Eight bytes from every place on.
        eight = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
        length = self.end - self.start
        value = length.astype(np.uint64)
        which = np.flatnonzero(length <= SHORT)
        for done in range(0, SHORT, 8):
            which = which[length[which] > done]
            if not len(which):
                break
            spare = 8 * np.maximum(0, done + 8 - length[which]).astype(np.uint64)
            part = eight[self.start[which] + done] << spare
            value[which] = mix((value[which] + STEP) ^ part)
        for i in np.flatnonzero(length > SHORT):
            digest = hashlib.blake2b(data[self.start[i]: self.end[i]].tobytes(), digest_size=8).digest()
            value[i] = int.from_bytes(digest, "little")
        return value

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (from row, to row, bytes, offsets). Null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, to, data[offsets[row]: offsets[to]], offsets[row: to + 1] - offsets[row]
        row = to


def windows(values: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """For every word whether ``size`` words from it on are still in its text."""
    left = np.repeat(np.cumsum(count), count) - np.arange(len(values))
    return left >= size


def joined(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` hashes in a row, from each place; the last ``size - 1`` places are of no use."""
    total = np.zeros(len(values), np.uint64)
    for shift in range(size):
        total[: len(values) - shift] += values[shift:] * FACTORS[shift % len(FACTORS)]
        if shift % len(FACTORS) == len(FACTORS) - 1:
            total = mix(total)
    return mix(total)
