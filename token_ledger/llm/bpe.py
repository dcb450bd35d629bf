"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings resolves a pre-token
that is itself a token. Tier two: other pre-tokens are merged, lowest rank first and
leftmost on ties, with a heap of candidate pairs over a doubly linked list of byte spans,
in O(n log n). The table has one slot for each token, so its size is the vocabulary's and
it is broadcast; texts stay partitioned and are read once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches

#: Bytes of pieces and ids in each of a Python worker's two memories, with 200 bytes for the entry of each piece; beyond it a memory starts anew.
MEMORY_BYTES = 64 << 20
_PRIME = (1 << 61) - 1
_BLANK_EDGE = re.compile(r" (?=\s|\Z)|\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@dataclass
class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys on n slots, each key checked by its bytes."""

    shifts: list[int]
    keys: list[bytes]
    values: list[int]

    @staticmethod
    def _parts(key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFFFFFF, (h >> 80) | 1

    @classmethod
    def build(cls, table: dict[bytes, int], load: int = 2) -> PerfectHash:
        n = len(table)
        groups: dict[int, list[tuple[int, int, bytes, int]]] = {}
        count = max(1, n // load)
        for key, value in table.items():
            a, b, c = cls._parts(key)
            groups.setdefault(a % count, []).append((b, c, key, value))
        shifts, keys, values = [0] * count, [b""] * n, [-1] * n
        taken, free = bytearray(n), 0
        for at, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(group) == 1:  # any free slot will do; it is noted as a negative shift
                while taken[free]:
                    free += 1
                _, _, key, value = group[0]
                shifts[at], taken[free], keys[free], values[free] = -1 - free, 1, key, value
                continue
            d = 0
            while True:
                spots = [(b + d * c) % _PRIME % n for b, c, _, _ in group]
                if len(set(spots)) == len(spots) and not any(taken[s] for s in spots):
                    break
                d += 1
                if d > 1 << 22:
                    raise ValueError("no displacement found; are two keys' hashes equal?")
            shifts[at] = d
            for s, (_, _, key, value) in zip(spots, group, strict=True):
                taken[s], keys[s], values[s] = 1, key, value
        return cls(shifts, keys, values)

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.keys:
            return -1
        a, b, c = self._parts(key)
        d = self.shifts[a % len(self.shifts)]
        s = (b + d * c) % _PRIME % len(self.keys) if d >= 0 else -1 - d
        return self.values[s] if self.keys[s] == key else -1


def merge_bytes(piece: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by lowest-rank-first merges, leftmost first among equal ranks."""
    n = len(piece)
    end = list(range(1, n + 1))  # a span that starts at i ends at end[i]; 0: it has joined the span before
    before = list(range(-1, n - 1))
    get, pop, push = rank_of.get, heapq.heappop, heapq.heappush
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = pop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of its two spans has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := get(piece[i : end[stop]])) is not None:
                push(heap, (rank, i, end[stop]))
        h = before[i]
        if h >= 0 and (rank := get(piece[h:stop])) is not None:
            push(heap, (rank, h, stop))
    out, i = [], 0
    while i < n:
        out.append(rank_of[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, table: PerfectHash, pattern: str):
        import regex

        self.table = table
        # White space as the Unicode property, the meaning that the pattern's own engine gives it.
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.ranks = dict(zip(table.keys, table.values, strict=True))  # of the pairs that merges ask for
        self.memory: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}
        self.memory_bytes = self.merged_bytes = 0
        size = max(table.values, default=-1) + 1
        tokens = [b""] * size
        for key, value in zip(table.keys, table.values, strict=True):
            tokens[value] = key
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _ids(self, text: str) -> bytes:
        out = []
        merged = self.merged
        for piece in self.split.findall(text):
            ids = merged.get(piece)
            if ids is None:
                raw = piece.encode()
                whole = self.table.get(raw)
                ids = array("I", [whole] if whole >= 0 else merge_bytes(raw, self.ranks)).tobytes()
                if len(piece) < 100:
                    self.merged_bytes += len(raw) + len(ids) + 200
                    if self.merged_bytes > MEMORY_BYTES:
                        merged.clear()
                        self.merged_bytes = 0
                    merged[piece] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers.

        No pre-token goes over a single blank between two other characters, so such a text is
        cut there and each piece's ids are remembered; other texts are split as a whole.
        """
        if _BLANK_EDGE.search(text):
            return self._ids(text)
        parts = text.replace(" ", "\n ").split("\n ") if "\n " not in text else None
        if parts is None:
            return self._ids(text)
        memory = self.memory
        if self.memory_bytes > MEMORY_BYTES:
            memory.clear()
            self.memory_bytes = 0
        pieces = [parts[0], *[" " + p for p in parts[1:]]]
        for piece in set(pieces):
            if piece not in memory:
                if len(piece) > 1000:
                    return self._ids(text)  # not worth remembering
                ids = memory[piece] = self._ids(piece)
                self.memory_bytes += 4 * len(piece) + len(ids) + 200
        return b"".join(map(memory.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        lengths = self.lengths[at]
        shift = np.repeat(self.starts[at] - (np.cumsum(lengths) - lengths), lengths)
        return self.blob[shift + np.arange(shift.size)].tobytes()


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec for these ranks; what it remembers serves later tasks too."""
    key, table, pattern = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(table, pattern)
    return _codecs[key]


def _each(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], pattern: str, schema: str, row) -> DataFrame:
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, PerfectHash.build(ranks), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows = [row(codec, text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))], ["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def bpe_encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (little-endian unsigned 32-bit ids as binary), one row per input row.

    A null text is an empty one and has no ids. Rows are independent: repeated rows give
    repeated results. Other columns are not read. An empty table gives an empty result.
    """
    return _each(df, id_col, text_col, ranks, pattern, "ids binary", lambda codec, text: (codec.encode(text),))


def bpe_decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` (bytes), one row per input row; null ids decode to nothing.

    Rows are independent: repeated rows give repeated results. Other columns are not read. An
    empty table gives an empty result.
    """
    return _each(df, id_col, ids_col, ranks, pattern, "decoded binary", lambda codec, ids: (codec.decode(bytes(ids or b"")),))


def bpe_digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encodes each text, then decodes its ids, in one pass.

    A null text is an empty one: no tokens, digests of nothing. Rows are independent: repeated
    rows and ids give repeated results, a null id stays null. Very long texts are encoded
    whole. Other columns are not read. An empty table gives an empty result.
    """

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _each(df, id_col, text_col, ranks, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
