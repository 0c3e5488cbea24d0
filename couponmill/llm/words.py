"""Words of whole texts as 64-bit numbers, computed on the UTF-8 bytes of Arrow columns.

A word is a run of digits, letters and non-ASCII characters with A-Z
lower-cased, the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Two different
words share a number with a chance of 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 2_000
# Longer words are hashed one by one.
LONG_WORD = 64

_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BYTE = np.random.default_rng(20_117).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; NULL is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``limit`` bytes of text."""
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word of all texts, and the index of the first word of each text."""
    low = _FOLD[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1], offsets[1:] - 1
    begins, ends = begins[begins < len(data)], ends[ends >= 0]
    first[begins], last[ends] = inside[begins], inside[ends]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    value = np.full(len(start), 7, np.uint64)
    at, k = np.flatnonzero(length <= LONG_WORD), 0
    while len(at):
        value[at] = (value[at] ^ _BYTE[low[start[at] + k]]) * _ODD
        k += 1
        at = at[length[at] > k]
    for i in np.flatnonzero(length > LONG_WORD):
        word = low[start[i] : start[i] + length[i]].tobytes()
        value[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return mix(value), np.searchsorted(start, offsets)


def ngrams(value: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each run of ``n`` words and the index of the first run of each text.

    A text of fewer words, but not none, has one run of all its words.
    """
    count = np.diff(index)
    run = np.zeros(len(value), np.uint64)
    full = max(len(value) - n + 1, 0)
    for k in range(n):
        run[:full] = run[:full] * _ODD + value[k : k + full]
    here = np.arange(len(value)) - np.repeat(index[:-1], count)
    valid = here <= np.repeat(count - n, count)
    for i in np.flatnonzero((count > 0) & (count < n)):
        total = np.full(1, count[i], np.uint64)
        for x in value[index[i] : index[i + 1]]:
            total = total * _ODD + x
        run[index[i]], valid[index[i]] = total[0], True
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    return mix(run[valid]), np.concatenate([[0], np.cumsum(runs)])
