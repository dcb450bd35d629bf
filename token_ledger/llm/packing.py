"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Lengths are whole numbers up to the capacity, so the packing depends only on how many
pieces have each length: a histogram of at most ``capacity`` rows, whatever the corpus.
The driver packs the histogram longest first; a segment tree over remaining capacities
finds the tightest open bin in logarithmic time, and pieces of one length that go to bins
of one remaining capacity move as one run. The plan is the same as packing document by
document. Spark numbers the pieces of each length (salted, so a length that a third of all
pieces share is spread) and looks each number up in the plan.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .runtime import shuffle_partitions, small_batches, staged

CAPACITY = 2048
END_ID = 0
#: Bytes of pieces that a Python worker remembers before it begins anew; of the memory before, it keeps what it meets.
MEMORY_BYTES = 60_000_000
#: What Python takes for a piece in the memory besides its letters and ids.
ENTRY_BYTES = 180
#: Bytes of text that are looked up at once.
SLICE_BYTES = 1 << 23
#: Shares that pieces of one length are numbered in: as many as shuffle partitions, within these bounds.
SALTS = 64, 1024


class SegmentTree:
    """Counts of open bins by remaining capacity; finds the smallest capacity that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.tree[at] += n
            at //= 2

    def first(self, least: int) -> int:
        """The smallest capacity of ``least`` or more that has a bin, or -1."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first number, pieces, first bin, pieces per bin, offset), best fit decreasing.

    Piece number ``first + k`` of a run goes to bin ``first bin + k // per_bin`` at
    ``offset + k % per_bin * length``.
    """
    tree = SegmentTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs of (first bin, bins)
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, number = counts[length], 0
        while left:
            room = tree.first(length)
            if room < 0:
                room, first, have = capacity, bins, -(-left // (capacity // length))
                bins += have
            else:
                first, have = open_bins[room].pop()
                tree.add(room, -have)
            per = room // length
            full = min(have, left // per)
            rest = min(per, left - full * per) if full < have else 0
            offset = capacity - room
            if full:
                runs.append((length, number, full * per, first, per, offset))
                put(room - per * length, first, full)
            if rest:
                runs.append((length, number + full * per, rest, first + full, rest, offset))
                put(room - rest * length, first + full, 1)
            used = full + bool(rest)
            put(room, first + used, have - used)
            left -= full * per + rest
            number += full * per + rest
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def _cut_table() -> np.ndarray:
    """Whether the tokenizer always cuts between two bytes, by 8 times the first one's kind and the second's.

    It cuts at white space, around a digit, and where signs and letters meet; not before the
    letters of a contraction, which an apostrophe opens. Beside a byte of a character beyond
    ASCII nothing is told, as that may join its neighbour.
    """
    table = np.zeros((8, 8), dtype=bool)
    for a, b in itertools.product((_LETTER, _DIGIT, _SIGN, _QUOTE), repeat=2):
        table[a, b] = _DIGIT in (a, b) or (a == _LETTER) != (b == _LETTER) and (a, b) != (_QUOTE, _LETTER)
    table[_SPACE], table[:, _SPACE] = True, True
    return table.ravel()


_SPACE, _LETTER, _DIGIT, _SIGN, _QUOTE, _WIDE = range(6)
_KIND = np.full(256, _WIDE, dtype=np.uint8)
_KIND[:128] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[ord("'")] = _QUOTE
_KIND[K.SPACE] = _SPACE
_CUT = _cut_table()
#: Letters that have no other normal form and whose lower case is one letter of these.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
#: The characters by which the tokenizer's merges spell bytes: those shown for themselves, the others by 256 and on; lines stay.
_SPELT = "".join("\n" if b == 10 else chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))


class WordEncoder:
    """Ids of whole texts by the tokenizer file, piece by piece with a memory.

    The tokenizer lower-cases, drops white space, and joins nothing over it, around digits or
    between letters and signs, so a text's ids are its pieces' ids in a row. Arrow tells the
    different pieces of a slice by their bytes; each is looked up once. Pieces of plain letters
    go straight to the tokenizer's merges. Special tokens are pieces as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of pieces, and those of the memory before, from which what is met again is taken over.
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of some texts in a row, and where each text's begin."""
        kind = _KIND[data]
        edge = np.ones(data.size + 1, dtype=bool)
        edge[1:-1] = _CUT[kind[:-1] << 3 | kind[1:]]
        low = K.LOWER[data]
        self._keep_special(data, low, offsets, edge)
        np.copyto(low[:-1], data[:-1], where=kind[1:] == _WIDE)  # a mark may follow, and join with one case only
        edge[offsets] = True
        solid = kind != _SPACE
        starts, ends = np.flatnonzero(solid & edge[:-1]), np.flatnonzero(solid & edge[1:]) + 1
        places = np.concatenate(([0], np.cumsum(ends - starts)))
        pieces = pa.Array.from_buffers(pa.large_binary(), starts.size, [None, pa.py_buffer(places), pa.py_buffer(low[solid])])
        return pieces, np.searchsorted(starts, offsets)

    def _keep_special(self, data: np.ndarray, low: np.ndarray, offsets: np.ndarray, edge: np.ndarray) -> None:
        """Makes a special token one piece; of another case it is plain text, which no lower-casing may change."""
        lowered = low.tobytes()
        for token in self.special:
            n, at = len(token), lowered.find(token.lower())
            while at >= 0:
                low[at : at + n] = data[at : at + n]
                one_text = np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + n - 1, side="right")
                if one_text and data[at : at + n].tobytes() == token:
                    edge[at + 1 : at + n] = False
                    edge[[at, at + n]] = True
                at = lowered.find(token.lower(), at + 1)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces by the tokenizer."""
        texts = b"\n".join(pieces).decode().split("\n")
        plain = [bool(_PLAIN.fullmatch(t)) and p not in self.special for t, p in zip(texts, pieces, strict=True)]
        spelt = "\n".join(itertools.compress(texts, plain)).lower().encode()
        codes = [[t.id for t in self.model.tokenize(word)] for word in codecs.charmap_decode(spelt, "strict", _SPELT)[0].split("\n")]
        raw = np.fromiter(itertools.chain.from_iterable(codes), dtype="<u4").tobytes()
        places = itertools.pairwise(itertools.accumulate((4 * len(c) for c in codes), initial=0))
        out = {piece: raw[lo:hi] for piece, (lo, hi) in zip(itertools.compress(pieces, plain), places, strict=False)}
        others = [piece for piece, is_plain in zip(pieces, plain, strict=True) if not is_plain]
        for first in range(0, len(others), 50):
            part = others[first : first + 50]
            texts = b"\n".join(part).decode()
            code = self.tokenizer.encode(texts, add_special_tokens=False)
            begins = [0, *itertools.accumulate(len(t) + 1 for t in texts.split("\n"))]
            cut = np.searchsorted(np.array([o[0] for o in code.offsets], dtype=np.int64), begins).tolist()
            raw = np.array(code.ids, dtype="<u4").tobytes()
            for piece, lo, hi in zip(part, cut, cut[1:], strict=False):
                out[piece] = raw[4 * lo : 4 * hi]
        return out

    def _codes(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces, from the memory where they are known."""
        codes = list(map(self.memory.get, pieces))
        missing = [p for p, c in zip(pieces, codes, strict=True) if c is None]
        if not missing:
            return codes
        found = {p: self.older[p] for p in missing if p in self.older}
        found |= self._learn([p for p in missing if p not in found])
        if self.held > MEMORY_BYTES:
            self.older, self.memory, self.held = self.memory, {}, 0
        self.memory |= found
        self.held += sum(len(p) + len(c) + ENTRY_BYTES for p, c in found.items())
        return [found[p] if c is None else c for p, c in zip(pieces, codes, strict=True)]

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        data, offsets = K.text_buffers(column)
        for first, end in K.slices(offsets, SLICE_BYTES):
            lo, hi = offsets[first], offsets[end]
            pieces, bounds = self._pieces(data[lo:hi], offsets[first : end + 1] - lo)
            met = pieces.dictionary_encode()
            codes = self._codes(met.dictionary.to_numpy(zero_copy_only=False).tolist())
            coded = pa.array(codes, pa.large_binary()).take(met.indices)
            _, places, ids = coded.buffers()
            raw = memoryview(ids or b"")
            places = np.frombuffer(places, dtype=np.int64)[: len(coded) + 1] if len(coded) else np.zeros(1, np.int64)
            for a, b in itertools.pairwise(places[bounds].tolist()):
                yield bytes(raw[a:b])


_encoders: dict[str, WordEncoder] = {}


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows ``id_col, piece, start, length, ids_crc32``: each text's ids and one end id, cut at ``capacity``.

    A null or empty text is one piece that holds the end id only.
    """

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder, tail = _encoders[tokenizer_path], np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder.encode_column(batch.column(1))):
                ids += tail
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append(k), piece.append(n), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )
        K.release_memory()

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def best_fit_pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: gapless from 0, at most ``capacity`` in a sequence.

    ``pieces`` needs ``id_col, piece, length``; lengths are 1 to ``capacity``. Equal lengths
    are numbered by (id, piece), so a repeated row gets a place of its own. An empty table
    gives an empty result. The plan that is broadcast has at most ``capacity`` squared runs
    and ``capacity`` x ``salts`` counts, whatever the corpus.
    """
    salts = salts or min(max(SALTS[0], shuffle_partitions(pieces.sparkSession)), SALTS[1])
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").count()
    rows = sizes.orderBy("length", "_salt").toPandas()  # at most capacity x salts rows
    counts = rows.groupby("length")["count"].sum()
    runs = plan_best_fit({int(k): int(v) for k, v in counts.items()}, capacity)
    rows["base"] = rows.groupby("length")["count"].cumsum() - rows["count"]
    base = np.zeros((capacity + 1, salts), dtype=np.int64)
    base[rows["length"].astype(int), rows["_salt"].astype(int)] = rows["base"]
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    begins = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
    # Bounded by the capacity: lengths x salts, and the runs of the plan.
    plan = pieces.sparkSession.sparkContext.broadcast((runs, begins, base))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, begins, base = plan.value
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_salt", "_rank"))
            number = rank - 1 + base[length, salt]
            run = np.empty(length.size, dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = begins[n], begins[n + 1]
                run[own] = lo + np.searchsorted(runs[lo:hi, 1], number[own], side="right") - 1
            _, first, _, first_bin, per, offset = runs[run].T
            k = number - first
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("_salt", "_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(first_bin + k // per), pa.array(offset + k % per * length)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece")).cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one end id. Rows that repeat an id are packed each on its own.
    A very long text is cut into full pieces and a rest. A null id stays null. Other columns of
    ``df`` are not read, whatever their names. An empty table gives an empty result.
    """
    return best_fit_pack(staged(token_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id), "pieces"), id_col, capacity)
