"""Streaming sources that follow folders: growing files by byte offsets, rolled ones as a whole.

Each trigger lists the folder and plans what is new: a range of bytes for each file that has
grown, from the start for one that is new or has shrunk. Files are opened by the tasks that read
them only. A line is told with the bytes that its end is in, so one without its end is left for a
later batch. Plans are files in a folder beside the checkpoint, numbered; the stream's
offset is the number of the last plan, so a batch that runs again reads the same ranges.
Large ranges are read in chunks by many tasks; a line belongs to the chunk that it starts in.
Small ones go together to a task, so a great many small files take few tasks.
What a task reads is a part of a plan, which it reads itself, and what is known of a file in the
driver is a digest of its path and a number: a great many files take little memory there.
Paths are of file systems that pyarrow knows (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .listing import BATCH, FILES, FOUND, OPEN_COST, hidden, opened, system_of, walk

CHUNK_BYTES = 64 << 20
#: Plans between two snapshots of all files' offsets, and bytes read at once.
SNAPSHOT_EVERY, BLOCK = 16, 4 << 20
_PLAN = pa.schema([("uri", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first", pa.bool_()), ("last", pa.int64()), ("modified", pa.float64()), ("reset", pa.bool_())])
_OFFSETS = pa.schema([("key", pa.binary(16)), ("end", pa.int64())])
SCHEMA = "file_path string, chunk bigint, row bigint, end bigint, value string, modified_at timestamp, reset boolean, begin bigint, last bigint"
_ARROW = pa.schema([("file_path", pa.string()), ("chunk", pa.int64()), ("row", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("reset", pa.bool_()), ("begin", pa.int64()), ("last", pa.int64())])


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Lines of a file that start in ``start <= byte < stop``; ``first``: and the line before ``start`` whose end is not before it; ``last``: where its planned bytes end."""

    uri: str
    path: str
    start: int
    stop: int
    first: bool
    last: int
    modified: float
    reset: bool


@dataclass
class Bundle:
    """Ranges that one task reads."""

    ranges: list[Range]


@dataclass
class Part(InputPartition):
    """A bundle of a plan: its place, and of its files those that a later plan of the batch resets and those that an earlier one has."""

    plan: int
    bundle: int
    void: frozenset[str] = frozenset()
    reset: frozenset[str] = frozenset()


def bundles(ranges: Iterable[Range], most: int) -> Iterator[Bundle]:
    """Ranges in their order, together as long as their bytes and openings stay within ``most``."""
    held, size = [], 0
    for r in ranges:
        cost = r.stop - r.start + OPEN_COST
        if held and size + cost > most:
            yield Bundle(held)
            held, size = [], 0
        held.append(r)
        size += cost
    if held:
        yield Bundle(held)


def last_line_end(file, start: int, size: int, block: int = 1 << 16) -> int:
    """The place behind the last line end in ``start <= byte < size``, ``start`` if there is none; read from the end."""
    high = size
    while high > start:
        low = max(start, high - block)
        file.seek(low)
        at = file.read(high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return start


def range_lines(file, start: int, stop: int, first: bool, last: int, block: int = BLOCK) -> Iterator[tuple[bytes, int]]:
    """(line, where it ends) of lines that start in a range; the last one may go on beyond it, up to ``last``."""
    begin = start if first else start - 1  # the line end before may be the byte before
    file.seek(begin)
    at, rest, skip = begin, b"", not first
    while at < last:
        data = file.read(min(block, last - at))
        if not data:
            return  # it has shrunk since
        parts = (rest + data).split(b"\n")
        line_start = at - len(rest)
        at += len(data)
        rest = parts.pop()
        for line in parts:
            if not skip:
                if line_start >= stop:
                    return
                yield line, line_start + len(line) + 1
            skip = False
            line_start += len(line) + 1
        if not skip and line_start >= stop:
            return


class Offsets:
    """A number for each path. Paths are told apart by 120 bits of a digest, sorted, so a file takes 24 bytes."""

    def __init__(self):
        self.keys, self.ends = np.empty(0, "S16"), np.empty(0, "int64")

    @staticmethod
    def keys_of(paths: Iterable[str]) -> np.ndarray:
        # The last byte is never 0, as numpy takes zeros off the end.
        return np.array([hashlib.blake2b(p.encode("utf-8", "surrogateescape"), digest_size=15).digest() + b"\1" for p in paths], "S16")

    def get(self, paths: list[str], otherwise: int) -> list[int]:
        keys = self.keys_of(paths)
        if not len(self.keys):
            return [otherwise] * len(paths)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ends[at], otherwise).tolist()

    def put(self, keys: np.ndarray, ends: np.ndarray) -> None:
        """Sets numbers; of a key that comes twice the last one stands."""
        every, ends = np.concatenate([self.keys, keys]), np.concatenate([self.ends, ends])
        order = np.argsort(every, kind="stable")
        every, ends = every[order], ends[order]
        stands = np.append(every[1:] != every[:-1], True)[: len(every)]
        self.keys, self.ends = every[stands], ends[stands]


class Planner:
    """Which bytes of a folder's files are to be read next; ``offsets`` has the bytes read of each file.

    A file that is written anew with exactly as many bytes as were read is taken as unchanged.
    """

    def __init__(self, path: str, glob: str, log: str, chunk: int = CHUNK_BYTES):
        self.system, self.scheme, self.root = self._place(path)
        self.logs, self.log = _system(log)
        self.glob, self.chunk = glob, chunk
        self.logs.create_dir(self.log, recursive=True)
        self.number, self.offsets, self.again = 0, Offsets(), 0.0
        self._load()

    def _place(self, path: str) -> tuple[fs.FileSystem, str, str]:
        system, root = _system(path)
        return system, path[: path.index(root)] if root in path else "", root

    def _names(self, kind: str) -> list[int]:
        found = self.logs.get_file_info(fs.FileSelector(self.log))
        return sorted(int(f.base_name.split("-")[1]) for f in found if f.base_name.startswith(kind + "-") and not f.base_name.endswith(".new"))

    def _load(self) -> None:
        """Goes on from the last snapshot and the plans after it."""
        if snapshots := self._names("offsets"):
            self.number = snapshots[-1]
            for b in _table(self.logs, self.log, "offsets", self.number):
                self.offsets.put(np.array(b["key"].to_pylist(), "S16"), b["end"].to_numpy())
        for number in self._names("plan"):
            if number > self.number:
                rows = [(self.offsets.keys_of(b["path"].to_pylist()), b["last"].to_numpy()) for b in _table(self.logs, self.log, "plan", number)]
                self._take(rows)
                self.number = number

    def _take(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.offsets.put(np.concatenate([k for k, _ in rows]), np.concatenate([e for _, e in rows]))

    def _new(self) -> Iterator[Range]:
        """Ranges of files that have changed; a part of the listing is held at a time."""
        for files in batched(walk(self.system, self.root, self.glob), BATCH):
            for (path, size, changed), known in zip(files, self.offsets.get([path for path, _, _ in files], 0), strict=True):
                if size != known:
                    yield Range(self.scheme, path, known if size > known else 0, size, True, size, changed / 1e9, size < known)

    def _bundles(self, ranges: Iterable[Range]) -> Iterator[Bundle]:
        return bundles(chain.from_iterable(map(self._chunks, ranges)), CHUNK_BYTES)

    def _chunks(self, r: Range) -> Iterable[Range]:
        if r.stop - r.start <= self.chunk:
            return (r,)
        return (replace(r, start=at, stop=min(at + self.chunk, r.stop), first=at == r.start) for at in range(r.start, r.stop, self.chunk))

    def plan(self) -> int:
        """Writes a plan if anything is new; the number of the last plan."""
        if time.monotonic() < self.again:
            return self.number
        began = time.monotonic()
        try:
            return self._plan()
        finally:
            # A listing stands for as long as it took, so that a trigger that asks twice has one and the driver is not always listing.
            self.again = 2 * time.monotonic() - began

    def _plan(self) -> int:
        parts = self._bundles(self._new())
        if (first := next(parts, None)) is None:
            return self.number
        taken = []

        def batches():
            for part in chain((first,), parts):
                taken.append((self.offsets.keys_of(r.path for r in part.ranges), np.array([r.last for r in part.ranges], "int64")))
                columns = zip(*((r.uri, r.path, r.start, r.stop, r.first, r.last, r.modified, r.reset) for r in part.ranges), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLAN, strict=True)], schema=_PLAN)

        self._write("plan", self.number + 1, _PLAN, batches())
        self.number += 1
        self._take(taken)
        if self.number % SNAPSHOT_EVERY == 0:
            keys, ends = self.offsets.keys, self.offsets.ends
            cuts = range(0, len(keys), 1 << 16)
            self._write("offsets", self.number, _OFFSETS, (pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].tolist(), pa.binary(16)), pa.array(ends[i : i + (1 << 16)])], schema=_OFFSETS) for i in cuts))
        return self.number

    def _write(self, kind: str, number: int, schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> None:
        name = f"{self.log}/{kind}-{number:09d}"
        with self.logs.open_output_stream(name + ".new") as f, pa.ipc.new_file(f, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in batches:
                out.write_batch(batch)
        self.logs.move(name + ".new", name)

    def parts(self, after: int, until: int) -> list[Part]:
        """Bundles of the plans after one up to another; of a file that was reset, from its last reset on."""
        numbers = range(after + 1, until + 1)
        if len(numbers) == 1:
            with self.logs.open_input_file(f"{self.log}/plan-{until:09d}") as f:
                return [Part(until, n) for n in range(pa.ipc.open_file(f).num_record_batches)]
        last: dict[str, int] = {}
        for number in numbers:
            for b in _table(self.logs, self.log, "plan", number):
                last |= dict.fromkeys(b.filter(b["reset"])["path"].to_pylist(), number)
        out = []
        for number in numbers:
            for n, b in enumerate(_table(self.logs, self.log, "plan", number)):
                again = last.keys() & set(b["path"].to_pylist()) if last else ()
                out.append(Part(number, n, frozenset(p for p in again if last[p] > number), frozenset(p for p in again if last[p] <= number)))
        return out


class RolledPlanner(Planner):
    """Which files have not been taken yet; they are not opened, and one that has been taken is not taken again."""

    def _place(self, path: str) -> tuple[fs.FileSystem, str, str]:
        return system_of(path)

    def _new(self) -> Iterator[Range]:
        for files in batched(walk(self.system, self.root, self.glob, hidden), BATCH):
            known = self.offsets.get([path for path, _, _ in files], -1)
            yield from (Range(self.scheme, path, 0, size, True, size, changed / 1e9, False) for (path, size, changed), k in zip(files, known, strict=True) if k < 0)

    def _bundles(self, ranges: Iterable[Range]) -> Iterator[Bundle]:
        return (Bundle(list(rows)) for rows in batched(ranges, BATCH))


def _table(logs: fs.FileSystem, log: str, kind: str, number: int) -> Iterator[pa.RecordBatch]:
    """The batches of a plan or snapshot, one at a time."""
    with logs.open_input_file(f"{log}/{kind}-{number:09d}") as f:
        held = pa.ipc.open_file(f)
        for n in range(held.num_record_batches):
            yield held.get_batch(n)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_ranges(system: fs.FileSystem, ranges: Iterable[Range]) -> Iterator[pa.RecordBatch]:
    """Lines of all ranges, in batches that go on from range to range.

    The first row of a range's first chunk tells where its lines begin and where its bytes end;
    if there is no line, a row without ``row`` and ``value`` does.
    """
    held: list[tuple] = []
    size = 0
    for r in ranges:
        at, begin, row = int(r.modified * 1_000_000), r.start, 0
        if r.start == r.stop:  # it has shrunk to nothing and may be gone since
            held.append((r.path, r.start, None, begin, None, at, r.reset, begin, r.last))
            continue
        with opened(system, r.path) as file:
            if r.first and r.start:
                begin = last_line_end(file, 0, r.start, 1 << 12)
            ends = (begin, r.last) if r.first else (None, None)
            for row, (line, end) in enumerate(range_lines(file, begin, r.stop, r.first, r.last), 1):
                held.append((r.path, r.start, row - 1, end, line.removesuffix(b"\r").decode(errors="replace"), at, r.reset, *ends))
                ends = (None, None)
                size += len(line)
                if size > BLOCK or len(held) >= BATCH:
                    yield _batch(held)
                    held, size = [], 0
        if r.first and not row:
            held.append((r.path, r.start, None, begin, None, at, r.reset, *ends))
    if held:
        yield _batch(held)


def read_again(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of chunks (``file_path, start, stop, last, modified``) of files that have become others."""
    rows = (r for b in batches for r in b.to_pylist())
    return read_ranges(_system(path)[0], (Range("", r["file_path"], r["start"], r["stop"], r["start"] == 0, r["last"], r["modified"], True) for r in rows))


class TailReader(DataSourceStreamReader):
    planner_of: type[Planner] = Planner

    def __init__(self, options: dict):
        self.path, self.glob, self.log = options["path"], options.get("glob", "*"), options["log"]
        self.chunk = int(options.get("chunkbytes", CHUNK_BYTES))
        self.planner: Planner | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "planner": None}  # it stays in the driver

    def _planner(self) -> Planner:
        if self.planner is None:
            self.planner = self.planner_of(self.path, self.glob, self.log, self.chunk)
        return self.planner

    def initialOffset(self) -> dict:
        return {"plan": 0}

    def latestOffset(self) -> dict:
        return {"plan": self._planner().plan()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self._planner().parts(start["plan"], end["plan"])

    def _ranges(self, part: Part) -> list[Range]:
        """The ranges of a part, read where it is worked on."""
        logs, log = _system(self.log)
        with logs.open_input_file(f"{log}/plan-{part.plan:09d}") as f:
            rows = zip(*(c.to_pylist() for c in pa.ipc.open_file(f).get_batch(part.bundle).columns), strict=True)
        ranges = [Range(*r) for r in rows if r[1] not in part.void]
        for r in ranges:
            r.reset |= r.path in part.reset
        return ranges

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return read_ranges(_system(self.path)[0], self._ranges(part))


class TailSource(DataSource):
    """``spark.readStream.format("tail")`` with ``path``, ``log`` (a folder for plans), ``glob`` and ``chunkBytes``.

    Gives a row for each line: its file, the chunk it starts in, its row there, where it ends,
    and what ``read_ranges`` tells beside.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


class RolledReader(TailReader):
    planner_of = RolledPlanner

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """A row for each file of a part."""
        ranges = self._ranges(part)
        shown = "" if self.path.startswith("file:") else ranges[0].uri
        at = [round(r.modified * 1_000_000) // 1000 * 1000 for r in ranges]  # as Spark tells it, in milliseconds
        yield pa.RecordBatch.from_arrays([pa.array([r.uri + r.path for r in ranges]), pa.array([shown + r.path for r in ranges]), pa.array([r.stop for r in ranges], pa.int64()), pa.array(at, pa.timestamp("us", "UTC"))], schema=FOUND)


class RolledSource(DataSource):
    """``spark.readStream.format("rolled")`` with ``path`` (a qualified URI), ``log`` and ``glob``: a row of ``listing.FILES`` for each file, once."""

    @classmethod
    def name(cls) -> str:
        return "rolled"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema) -> RolledReader:
        return RolledReader({k.lower(): v for k, v in self.options.items()})
