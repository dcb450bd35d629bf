"""Token counts by a map-side two-tier lookup of pre-token lengths.

A text is cut at places where the byte-level pattern always ends a pre-token, so the lengths
of its pieces add up to its length. Cutting is array work on the bytes of a whole batch, and a
batch looks each distinct piece up once. Tier one is a compact hash table of the frequent
pieces and their lengths, broadcast; its size is a parameter. Tier two are caches that the
workers keep, bounded by bytes, in front of the tokenizer. Which pieces are frequent is
found by summaries of bounded size that each task makes of all its texts and that are merged
in levels, so no piece of a text is ever shuffled. Counts do not depend on what is in the
table or the caches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .runtime import small_batches, staged

#: Pieces in the broadcast table; a task's summary counts four times as many.
TABLE_ENTRIES = 16_384
LIMIT = 512
#: Bytes of pieces that a worker remembers, with 100 bytes for the entry of each.
CACHE_BYTES = 48 << 20
#: Longer pieces are not remembered.
LONGEST = 1_000
#: Summaries that one task merges.
FAN = 64

_SPACE, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _OTHER, _HIGH = range(7)
_KIND = np.full(256, _SIGN, dtype=np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
_KIND[28:32] = _OTHER  # white space to some engines and not to others
_KIND[128:] = _HIGH

#: Whether a pre-token ends between two bytes of these kinds. An apostrophe may take letters along.
_CUTS = np.zeros((7, 7), dtype=bool)
_CUTS[[_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _HIGH], _SPACE] = True
_CUTS[_LETTER, [_DIGIT, _SIGN, _APOSTROPHE]] = True
_CUTS[_DIGIT, [_LETTER, _SIGN, _APOSTROPHE]] = True
_CUTS[_SIGN, [_LETTER, _DIGIT]] = True
_CUTS[_APOSTROPHE, _DIGIT] = True

#: First bytes of the white space beyond ASCII, and the characters.
_WIDE_LEADS = np.array([0xC2, 0xE1, 0xE2, 0xE3], dtype=np.uint8)
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _found(raw: bytes, part: bytes) -> Iterator[int]:
    at = raw.find(part)
    while at >= 0:
        yield at
        at = raw.find(part, at + 1)


def cut_places(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Starts of the pieces of the texts ``data[offsets[i]:offsets[i + 1]]``, and the end of the last.

    Special strings stay whole, within their piece.
    """
    kind = _KIND[data]
    cut = np.zeros(data.size + 1, dtype=bool)
    cut[1:-1] = _CUTS[kind[:-1], kind[1:]]
    if np.isin(data, _WIDE_LEADS).any():
        raw = data.tobytes()
        for space in _WIDE_SPACE:
            for at in _found(raw, space):
                cut[at + len(space)] = False
    raw = None
    for text in special:
        raw = data.tobytes() if raw is None else raw
        for at in _found(raw, text):
            cut[at + 1 : at + len(text)] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


def distinct_pieces(column: pa.Array, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first piece of each text and the number of pieces, number of each piece's distinct piece, distinct pieces)."""
    data, offsets = K.text_buffers(column)
    if not data.size:
        return np.zeros(offsets.size, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], pa.large_binary())
    at = cut_places(data, offsets, special)
    pieces = pa.Array.from_buffers(pa.large_binary(), at.size - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return np.searchsorted(at, offsets), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


@dataclass
class LengthTable:
    """Hash table by open addressing over arrays: a piece's hash, where its bytes are, and its length in tokens."""

    hashes: np.ndarray
    at: np.ndarray
    lengths: np.ndarray
    blob: bytes

    @classmethod
    def build(cls, lengths: dict[bytes, int]) -> LengthTable:
        keys = list(lengths)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        starts = np.cumsum([0, *map(len, keys)]).astype(np.int64)
        hashes, at, found = np.zeros(size, np.uint64), np.full((size, 2), -1, np.int64), np.zeros(size, np.int64)
        for n, (key, h) in enumerate(zip(keys, K.hash_bytes(iter(keys), len(keys)), strict=True)):
            slot = int(h) & (size - 1)
            while at[slot, 0] >= 0:
                slot = (slot + 1) & (size - 1)
            hashes[slot], at[slot], found[slot] = h, (starts[n], starts[n + 1]), lengths[key]
        return cls(hashes, at, found, b"".join(keys))

    def get(self, pieces: list[bytes]) -> np.ndarray:
        """Lengths of the pieces, -1 for those that are not in the table; a hit is checked by its bytes."""
        out = np.full(len(pieces), -1, dtype=np.int64)
        wanted, mask = K.hash_bytes(iter(pieces), len(pieces)), np.uint64(self.hashes.size - 1)
        left, slot = np.arange(len(pieces)), (wanted & mask).astype(np.int64)
        while left.size:
            full = self.at[slot, 0] >= 0
            left, slot = left[full], slot[full]
            same = self.hashes[slot] == wanted[left]
            hit = np.zeros(left.size, dtype=bool)
            for n in np.flatnonzero(same):
                lo, hi = self.at[slot[n]]
                if self.blob[lo:hi] == pieces[left[n]]:
                    hit[n], out[left[n]] = True, self.lengths[slot[n]]
            left, slot = left[~hit], (slot[~hit] + 1) & int(mask)
        return out


class Cache:
    """What a worker remembers: two generations of at most half of ``most`` bytes each."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.size = most // 2, {}, {}, 0

    def get(self, key: bytes) -> int | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value: int) -> None:
        if len(key) > LONGEST or key in self.young:
            return
        self.size += len(key) + 100
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, len(key) + 100
        self.young[key] = value


class Counter:
    """Lengths of pieces in one worker: the table, then the cache, then the tokenizer."""

    def __init__(self, tokenizer: str, table: LengthTable, cache_bytes: int):
        self.tokenizer, self.table, self.cache = load_tokenizer(tokenizer), table, Cache(cache_bytes)

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        out = self.table.get(pieces)
        asked = []
        for n in np.flatnonzero(out < 0).tolist():
            known = self.cache.get(pieces[n])
            if known is None:
                asked.append(n)
            else:
                out[n] = known
        for part in _by_bytes(asked, pieces):
            for n, length in zip(part, token_lengths(self.tokenizer, [pieces[n] for n in part]), strict=True):
                out[n] = length
                self.cache.put(pieces[n], length)
        return out


def _by_bytes(numbers: list[int], pieces: list[bytes], most: int = 1 << 18) -> Iterator[list[int]]:
    """The numbers in runs of at most ``most`` bytes of pieces, or one piece."""
    run, size = [], 0
    for n in numbers:
        if run and size + len(pieces[n]) > most:
            yield run
            run, size = [], 0
        run.append(n)
        size += len(pieces[n])
    if run:
        yield run


def load_tokenizer(definition: str):
    """The library's tokenizer of a JSON definition, on one thread, which is all that a task has."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(definition)
    out.no_truncation()
    out.no_padding()
    return out


def token_lengths(tokenizer, pieces: list[bytes]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]


def special_strings(tokenizer) -> list[bytes]:
    return [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]


def _lowered(counts: dict[bytes, int], keep: int) -> dict[bytes, int]:
    """The ``keep`` largest counts, less the next largest: what occurs in more than one of ``keep`` pieces of all that was counted is never lost."""
    if len(counts) <= keep:
        return counts
    cut = sorted(counts.values(), reverse=True)[keep]
    return {k: n - cut for k, n in counts.items() if n > cut}


_SUMMARY = "part int, pieces array<binary>, counts array<bigint>"


def _summary_batch(part: int, counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(counts)], pa.list_(pa.binary())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["part", "pieces", "counts"])


def frequent_pieces(texts: DataFrame, special: list[bytes], entries: int = TABLE_ENTRIES) -> dict[bytes, int]:
    """At most ``entries`` frequent pieces of all texts of a one-column table, with lower bounds of their counts.

    Each task sends one summary of four times ``entries`` counts at most, whatever it has read.
    """
    keep = 4 * entries

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            _, codes, pieces = distinct_pieces(batch.column(0), special)
            if not codes.size:
                continue
            n = np.bincount(codes, minlength=len(pieces))
            short = pc.less_equal(pc.binary_length(pieces), LONGEST).to_numpy(zero_copy_only=False)
            for piece, count in zip(pieces.filter(pa.array(short)).to_pylist(), n[short].tolist(), strict=True):
                counts[piece] = counts.get(piece, 0) + count
            if len(counts) > 2 * keep:
                counts = _lowered(counts, keep)
        if counts:
            yield _summary_batch(TaskContext.get().partitionId(), _lowered(counts, keep))
        K.release_memory()

    def merged(table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for pieces, numbers in zip(table["pieces"], table["counts"], strict=True):
            for piece, n in zip(pieces.as_py(), numbers.as_py(), strict=True):
                counts[piece] = counts.get(piece, 0) + n
        return pa.Table.from_batches([_summary_batch(table["part"][0].as_py() // FAN, _lowered(counts, keep))])

    summaries = staged(texts.mapInArrow(summarise, _SUMMARY), "tokens-summaries")
    while summaries.count() > 1:
        summaries = staged(summaries.withColumn("level", F.floor(F.col("part") / FAN)).groupBy("level").applyInArrow(lambda table: merged(table.drop_columns("level")), _SUMMARY), "tokens-summaries")
    row = summaries.first()
    if row is None:
        return {}
    best = sorted(zip(row["counts"], map(bytes, row["pieces"]), strict=True), key=lambda x: (-x[0], x[1]))[:entries]
    return {piece: n for n, piece in best}


_counters: dict[str, Counter] = {}


def _counter(shared) -> Counter:
    """The worker's counter for this table; what it remembers serves later tasks too."""
    key, tokenizer, table, cache_bytes = shared.value
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(tokenizer, table, cache_bytes)
    return _counters[key]


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, entries: int = TABLE_ENTRIES, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit``, one row per input row, by a byte-level tokenizer file of the ``tokenizers`` library.

    The file's own special strings inside a text are one token each, as the library has it;
    none is added at the ends. A null text is an empty one and has no tokens; a null id stays
    null. Rows are independent: repeated rows and ids give repeated results. Very long texts
    are counted whole, a text without blanks as one piece. Other columns are not read, so
    their names do not matter. An empty table gives an empty result. The broadcast table
    holds ``entries`` pieces of at most 1,000 bytes; a worker's cache holds ``cache_bytes``.
    """
    small_batches(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    tokenizer = load_tokenizer(definition)
    special = special_strings(tokenizer)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    frequent = list(frequent_pieces(rows.select("body"), special, entries))
    table = LengthTable.build(dict(zip(frequent, token_lengths(tokenizer, frequent), strict=True)))
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, definition, table, cache_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for batch in batches:
            first, codes, pieces = distinct_pieces(batch.column(1), special)
            n = K.sum_by(first, counter.lengths(pieces.to_pylist())[codes]) if codes.size else np.zeros(batch.num_rows, np.int64)
            _, offsets = K.text_buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])
        K.release_memory()

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
