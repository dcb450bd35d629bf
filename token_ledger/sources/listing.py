"""Folders and files of file systems that pyarrow knows, so that tasks can list and read a great many of them.

Spark's readers list all files in the driver and take milliseconds to open each; here tasks list
folders, files are rows, and each is opened once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase, translate
from functools import partial, reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

#: Folders from which on tasks go down by themselves; above, each level is one job.
WIDE = 64
#: Rows of a batch of files, bytes of files that a task reads, and what opening one counts as.
BATCH, TASK_BYTES, OPEN_COST = 10_000, 64 << 20, 32 << 10
FILES = "uri string, file_path string, length bigint, modified_at timestamp"
FOUND = pa.schema([("uri", pa.string()), ("file_path", pa.string()), ("length", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))])


def system_of(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, what stands before its paths, path) of a qualified URI; ValueError if pyarrow doesn't know it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "file:", re.sub("^file:/+", "/", uri)  # taken as it stands, as Hadoop does
    system, path = fs.FileSystem.from_uri(uri)
    return system, uri.removesuffix(path), path


def known_place(spark: SparkSession, path: str) -> str | None:
    """The qualified URI of a folder, or None if it is none or pyarrow doesn't know its file system."""
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(place).toString()
    try:
        own, _, root = system_of(uri)
        there = own.get_file_info(root).type == fs.FileType.Directory
        return uri if there and uri.endswith(root) else None
    except (ValueError, OSError):
        return None


def plain(glob: str) -> bool:
    """Whether a pattern of names means the same here as to Spark's readers."""
    return not re.search(r"[\[\]{}\\]", glob)


def hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None, int]]:
    """(name, bytes or None for a folder, nanoseconds of its last change) of what is in a folder; none if it is gone."""
    if not isinstance(system, fs.LocalFileSystem):
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            yield f.base_name, None if f.type == fs.FileType.Directory else f.size, f.mtime_ns or 0
        return
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir():
                    yield e.name, None, 0
                elif e.is_file():
                    try:
                        stat = e.stat()
                    except FileNotFoundError:
                        continue
                    yield e.name, stat.st_size, stat.st_mtime_ns
    except FileNotFoundError:
        return


def walk(system: fs.FileSystem, folder: str, glob: str, skip=lambda name: False) -> Iterator[tuple[str, int, int]]:
    """(path, bytes, nanoseconds) of the files below a folder; one folder is listed at a time."""
    due, named = [folder.rstrip("/")], re.compile(translate(glob)).match
    while due:
        at = due.pop()
        for name, size, changed in entries(system, at):
            if skip(name):
                continue
            if size is None:
                due.append(f"{at}/{name}")
            elif named(name):
                yield f"{at}/{name}", size, changed


def _list(root: str, glob: str, deep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of folders, and below them if ``deep``; else a row without a length for each folder in them."""
    system, before, _ = system_of(root)
    shown = "" if before == "file:" else before

    def found():
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                if deep:
                    yield from walk(system, folder, glob, hidden)
                    continue
                at = folder.rstrip("/")
                for name, size, changed in entries(system, folder):
                    if not hidden(name) and (size is None or fnmatchcase(name, glob)):
                        yield f"{at}/{name}", size, changed

    rows = found()
    while held := list(islice(rows, BATCH)):
        paths, sizes, changed = zip(*held, strict=True)
        # Spark tells milliseconds of a file.
        at = [c // 1_000_000 * 1000 for c in changed]
        yield pa.RecordBatch.from_arrays([pa.array([before + p for p in paths]), pa.array([shown + p for p in paths]), pa.array(sizes, pa.int64()), pa.array(at, pa.timestamp("us", "UTC"))], schema=FOUND)


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``uri, file_path, length, modified_at`` of the files below a folder, listed by tasks and staged; the driver sees names of folders only."""
    _, before, folder = system_of(root)
    out, due = [], [folder]
    while due:
        deep = len(due) >= WIDE
        folders = spark.createDataFrame([(f,) for f in due], "folder string").repartition(min(len(due), 4 * spark.sparkContext.defaultParallelism))
        found = staged(folders.mapInArrow(partial(_list, root, glob, deep), FILES), "listing")
        out.append(found.filter("length IS NOT NULL"))
        due = [] if deep else [r["uri"].removeprefix(before) for r in found.filter("length IS NULL").select("uri").collect()]
    return reduce(DataFrame.unionByName, out)


def _contents(root: str, batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``file_path, value, modified_at``: whole files as bytes, in batches of about ``most`` bytes."""
    schema = pa.schema([("file_path", pa.string()), ("value", pa.binary()), ("modified_at", pa.timestamp("us", "UTC"))])
    system, before, _ = system_of(root)
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for rows in batches:
        for uri, path, at in zip(rows["uri"].to_pylist(), rows["file_path"].to_pylist(), rows["modified_at"].cast(pa.int64()).to_pylist(), strict=True):
            with opened(system, uri.removeprefix(before)) as file:
                value = file.read()
            held.append((path, value, at))
            size += len(value) + 256
            if size > most:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def opened(system: fs.FileSystem, path: str):
    """A file to seek and read in."""
    return open(path, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def whole_files(files: DataFrame, root: str) -> DataFrame:
    """``file_path, value, modified_at`` of a table of files below a folder, each read at once where its row is."""
    return files.select("uri", "file_path", "modified_at").mapInArrow(partial(_contents, root), "file_path string, value binary, modified_at timestamp").withColumn("value", F.col("value").cast("string"))


def by_tasks(files: DataFrame) -> DataFrame:
    """The same files, dealt to tasks of about ``TASK_BYTES``, where opening one counts as ``OPEN_COST``."""
    size = files.agg(F.sum(F.col("length") + OPEN_COST)).first()[0] or 0
    return files.repartition(max(-(-size // TASK_BYTES), files.sparkSession.sparkContext.defaultParallelism), "uri")
