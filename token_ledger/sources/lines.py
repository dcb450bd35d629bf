"""Files as rows: lines with their numbers, whole documents, listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segments import number_rows
from ..session import can_stage
from . import listing

#: Bytes of a file that is read at once.
WHOLE_BYTES = 4 << 20
#: Files that are left to Spark's own listing.
FEW_FILES = 1_000
#: Endings of files that Spark's readers unpack.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"


def plain_path(uri: Column) -> Column:
    """A local file's path without scheme and escapes; other URIs as they are."""
    local = F.regexp_replace(uri, "^file:/+", "/")
    return F.url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))


def _place() -> tuple[Column, Column]:
    """Path and time of the file that a row comes from."""
    return plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_modification_time").alias("modified_at")


def _cut(whole: DataFrame) -> DataFrame:
    """Lines of whole files (``file_path, value, modified_at``) with their numbers."""
    # Lines end as the text source ends them, which skips a mark at a file's start and has no line after the last end.
    text = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"(\r\n|\n|\r)\z", "")
    marked = whole.filter(~F.col("value").isin("", "\ufeff"))
    lines = marked.select("file_path", "modified_at", F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "value"))
    return lines.select("file_path", F.col("line").cast("bigint").alias("line"), "value", "modified_at")


def _cut_by_blocks(raw: DataFrame) -> DataFrame:
    """Lines of files that are read by blocks, numbered in their block after the lines of the blocks before; ``raw`` has ``value`` and its source's metadata."""
    # Both branches of number_rows must cut files alike: they read ``_id``, below which no filter of a reader goes to one scan alone.
    large = raw.select("value", *_place(), F.col("_metadata.file_block_start").alias("_block"), F.nullif(F.monotonically_increasing_id(), F.lit(-1)).alias("_id"))
    return number_rows(large, "_block", "_id").select("file_path", F.col("row").alias("line"), "value", "modified_at")


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", whole_bytes: int = WHOLE_BYTES, few: int = FEW_FILES) -> DataFrame:
    """``file_path, line`` (from 0), ``value, modified_at`` of non-blank lines under a folder.

    A file of up to ``whole_bytes`` is read at once and numbered where it is read, so a great
    many small files are read once and nothing of them is shuffled. Lines of larger ones are
    numbered in the block that they are read from, after the lines of the blocks before, so a
    file may be split over many tasks and is never sorted in one. More than ``few`` files are
    listed by tasks and dealt to tasks as rows, where pyarrow knows the file system.
    """
    if (root := listing.known_place(spark, path)) and listing.plain(glob) and can_stage(spark):
        found = listing.list_files(spark, root, glob)
        if found.count() > few:
            return lines_of(found, root, whole_bytes).filter(F.trim("value") != "")
    size, files = F.col("_metadata.file_size"), spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    # Files are left out by their size before they are opened.
    small = files.text(path, wholetext=True).filter(size <= whole_bytes).select("value", *_place())
    return _cut(small).unionByName(_cut_by_blocks(files.text(path).filter(size > whole_bytes))).filter(F.trim("value") != "")


def lines_of(files: DataFrame, root: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``file_path, line, value, modified_at`` of all lines of a table of files below a folder (``listing.FILES``), blank ones too.

    Small files are dealt to tasks as rows and read there; only names of large and packed ones
    go through the driver, to Spark's reader. The table is read more than once.
    """
    apart = (F.col("length") > whole_bytes) | F.lower("uri").rlike(_PACKED)
    names = [r["uri"] for r in files.filter(apart).select("uri").collect()]
    out = _cut(listing.whole_files(listing.by_tasks(files.filter(~apart)), root))
    if not names:
        return out
    escaped = [re.sub(r"([*?\[\]{}\\])", r"\\\1", n) for n in names]
    return out.unionByName(_cut_by_blocks(files.sparkSession.read.text(escaped)))


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``file_path, value, modified_at``: one row for each file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(plain_path(F.col("_metadata.file_path")).alias("file_path"), "value", F.col("_metadata.file_modification_time").alias("modified_at"))


def discover_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file_path, length, modified_at``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select(plain_path(F.col("path")).alias("file_path"), "length", F.col("modificationTime").alias("modified_at")).distinct().orderBy("file_path")


def prefer_live_over_archived(files: DataFrame) -> DataFrame:
    """Files of which each home's relative path is kept once, ``sessions`` before ``archived_sessions``.

    Adds ``home`` and ``relative_path``. Files outside both folders are all kept.
    """
    at = r"^(.*)/(sessions|archived_sessions)/(.*)$"
    inside = F.col("file_path").rlike(at)
    out = files.withColumns({"home": F.when(inside, F.regexp_extract("file_path", at, 1)), "relative_path": F.when(inside, F.regexp_extract("file_path", at, 3)).otherwise(F.col("file_path")), "_archived": F.regexp_extract("file_path", at, 2) == "archived_sessions"})
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("home", "relative_path").orderBy("_archived", "file_path"))).filter("_n = 1").drop("_n", "_archived")


def _named(df: DataFrame, glob: str) -> DataFrame:
    return df.filter(F.regexp_extract("file_path", "[^/]*$", 0).rlike("^" + re.escape(glob).replace(r"\*", ".*") + "$"))


def as_lines(spark: SparkSession, source: str | DataFrame, glob: str = "*.jsonl") -> DataFrame:
    """Lines of a folder, or of a table ``file_path, line, value, modified_at`` that holds lines already."""
    return _named(source, glob) if isinstance(source, DataFrame) else read_lines(spark, source, glob)


def as_documents(spark: SparkSession, source: str | DataFrame, glob: str = "*.json") -> DataFrame:
    """Documents of a folder, or those of a table of lines (one line each)."""
    return _named(source, glob).drop("line") if isinstance(source, DataFrame) else read_documents(spark, source, glob)
