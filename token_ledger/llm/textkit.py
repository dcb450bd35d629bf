"""Whole-batch text statistics on Arrow string buffers.

Python tasks read the UTF-8 buffer of an Arrow column as one numpy array, so a batch of
documents costs a few array passes instead of a Python object per word. Words are runs of
bytes other than the six ASCII white-space bytes 20 and 09-0D, the same as
``[^\\x20\\x09-\\x0D]+`` on the decoded text. Word identity is the 64-bit xxh3 hash of the
word's bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one array pass handles; a longer document is handled alone, whole.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_bytes(parts: Iterator[bytes], n: int) -> np.ndarray:
    """64-bit hashes of ``n`` byte strings."""
    return np.fromiter(map(xxh3_64_intdigest, parts), dtype=np.uint64, count=n)


@dataclass
class Words:
    """Words of some documents: byte spans, hashes, and the first word of each document."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    raw: bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.counts.size), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i + 1]]``."""
    if lower:
        data = LOWER[data]
    n = data.shape[0]
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = True, ~solid[:-1]
        after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    raw = data.tobytes()
    parts = itertools.chain.from_iterable(raw[lo:hi].split() for lo, hi in itertools.pairwise(offsets.tolist()))  # splits at the same six bytes
    return Words(data, offsets, starts, ends, hash_bytes(parts, starts.size), np.searchsorted(starts, offsets), raw)


def windows(words: Words, k: int, same_doc: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words inside one document."""
    total = words.hashes.size
    if total < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.full(total - k + 1, k, dtype=np.uint64)
    for j in range(k):
        value = mix((value ^ words.hashes[j : total - k + 1 + j]) * np.uint64(0xC2B2AE3D27D4EB4F))
    doc = words.doc
    first = np.flatnonzero(doc[: total - k + 1] == doc[k - 1 :])
    return first, value[first]


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the value occurs twice or more in its document; it occurred earlier there."""
    order = np.lexsort((np.arange(value.size), value, doc))
    d, v = doc[order], value[order]
    same = np.zeros(value.size, dtype=bool)
    same[1:] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out_twice, out_later = np.empty_like(same), np.empty_like(same)
    out_twice[order], out_later[order] = twice, same
    return out_twice, out_later


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, of one row at least."""
    row, rows = 0, offsets.size - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def batch_words(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of consecutive slices of a string column."""
    data, offsets = text_buffers(column)
    for first, end in slices(offsets, most):
        lo, hi = offsets[first], offsets[end]
        yield first, end, split_words(data[lo:hi], offsets[first : end + 1] - lo, lower)


def sum_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def release_memory() -> None:
    """Gives free memory back to the system at a task's end; the Python worker lives on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
