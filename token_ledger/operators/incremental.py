"""What to read again, and from where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """``listing`` (``file_path, length, modified_at``) with ``action`` and ``line_index`` to start from.

    Unchanged (same size, not over 1 ms newer) is skip, smaller is reset, unknown is full,
    anything else is tail.
    """
    s = state.select("file_path", F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime"), F.col("line_index").alias("_line"))
    newer = F.unix_micros(F.col("modified_at").cast("timestamp")) - F.unix_micros(F.col("_mtime").cast("timestamp"))
    action = F.when(F.col("_size").isNull(), "full").when(F.col("length") < F.col("_size"), "reset").when((F.col("length") == F.col("_size")) & (newer <= 1000), "skip").otherwise("tail")
    out = listing.join(s, "file_path", "left").withColumn("action", action)
    return out.withColumn("line_index", F.when(F.col("action") == "tail", F.col("_line")).otherwise(0).cast("bigint")).drop("_size", "_mtime", "_line")


def tail_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Lines at or after the planned index of files that are to be read; line numbers stay."""
    p = plan.filter("action != 'skip'").select("file_path", F.col("line_index").alias("_from"))
    return lines.join(p, "file_path").filter(F.col("line") >= F.col("_from")).drop("_from")


def rowid_watermark(df: DataFrame, last: int, rowid: str = "rowid") -> DataFrame:
    """Rows above the last row id seen; all rows if the table's largest id went down."""
    top = df.agg(F.coalesce(F.max(rowid), F.lit(0)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).filter((F.col("_top") < last) | (F.col(rowid) > last)).drop("_top")  # one row


def session_fingerprint(model: str = "model_raw", cost: str = "reported_cost"):
    """Text that changes when a session's model, counts or cost do."""
    from ..schema import TOKENS

    return F.concat_ws("|", F.col(model), *(F.col(t).cast("string") for t in TOKENS), F.coalesce(F.col(cost).cast("string"), F.lit("")))


def changed_sessions(df: DataFrame, fingerprints: DataFrame, key: str = "session_id") -> DataFrame:
    """Session rows whose ``fingerprint`` differs from the stored one, or has none."""
    old = fingerprints.select(key, F.col("fingerprint").alias("_old"))
    return df.join(old, key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")


def canonical_path(path):
    """The path without a database's side-file suffix."""
    return F.regexp_replace(path, "-(wal|shm|journal)$", "")


def changed_path_filter(files: DataFrame, changed: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Files equal to, under, or over a changed path; all files without any change.

    With ``roots`` (``root``), a changed path outside every root asks for a full scan. Paths
    meet by equality: each file's own prefixes against changes, and each change's prefixes
    against files, so no pair is tried in vain.
    """
    c = changed.select(canonical_path(F.col("path")).alias("_p")).distinct()
    everything = c.isEmpty()
    if not everything and roots is not None:
        inside = c.withColumn("root", F.explode(prefixes(F.col("_p")))).join(roots, "root", "left_semi").select("_p").distinct()
        everything = not c.join(inside, "_p", "left_anti").isEmpty()
    if everything:
        return files
    f = files.select("file_path").distinct()
    under = f.withColumn("_p", F.explode(prefixes(F.col("file_path")))).join(c, "_p", "left_semi").select("file_path")
    over = c.withColumn("file_path", F.explode(prefixes(F.col("_p")))).join(f, "file_path", "left_semi").select("file_path")
    return files.join(under.union(over).distinct(), "file_path", "left_semi")


def prefixes(path):
    """The path and all folders over it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_summary(plan: DataFrame, events: DataFrame, stored: DataFrame) -> DataFrame:
    """Per source: files scanned and skipped, events parsed and stored."""
    files = plan.groupBy("source_id").agg(F.count_if(F.col("action") != "skip").alias("files_scanned"), F.count_if(F.col("action") == "skip").alias("files_skipped"))
    parsed = events.groupBy("source_id").agg(F.count(F.lit(1)).alias("events_parsed"))
    kept = stored.groupBy("source_id").agg(F.count(F.lit(1)).alias("events_stored"))
    out = files.join(parsed, "source_id", "full").join(kept, "source_id", "full")
    return out.select("source_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("files_scanned", "files_skipped", "events_parsed", "events_stored")))
