"""Order-dependent semantics of cumulative counters in log files.

Every scan is along the lines of a file; only narrow columns are sorted. With ``block`` a file
is parted over many tasks (``segments``), without it is scanned in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .segments import Carry, carry_along

COUNTER_FIELDS = ("input", "cached", "output", "reasoning", "total")
FALLBACK_MODEL = "gpt-5"
REVIEW_MODEL, REVIEW_SINCE, REVIEW_TARGET = "codex-auto-review", "2026-02-01", "gpt-5.1-codex"


def previous_total(df: DataFrame, total: str = "total", out: str = "_previous", block: int | None = None) -> DataFrame:
    """``out``: the last non-null total before each row of the same file."""
    return carry_along(df, {out: Carry(F.col(total))}, block=block)


def drop_repeated_snapshot(df: DataFrame, total: str = "total", block: int | None = None) -> DataFrame:
    """Without rows whose total equals, in all fields, the last total before them."""
    same = F.col(total).isNotNull() & F.coalesce(F.col(total) == F.col("_previous"), F.lit(False))
    return previous_total(df, total, block=block).filter(~same).drop("_previous")


def usage_of(total: str = "total", last: str = "last", previous: str = "_previous") -> Column:
    """The row's own usage if it tells one, else its total less the total before it, each field at least 0."""
    zero = F.lit(0).cast("bigint")
    part = lambda f: F.greatest(zero, F.col(f"{total}.{f}") - F.coalesce(F.col(f"{previous}.{f}"), zero)).alias(f)
    delta = F.when(F.col(total).isNotNull(), F.struct(*(part(f) for f in COUNTER_FIELDS)))
    own = F.when(F.col(last).isNotNull(), F.struct(*(F.col(f"{last}.{f}").alias(f) for f in COUNTER_FIELDS)))
    return F.coalesce(own, delta)


def counter_delta(df: DataFrame, total: str = "total", last: str = "last", out: str = "usage", block: int | None = None) -> DataFrame:
    """``out``: the row's own usage if it tells one, else its total less the last total before it, each field at least 0.

    Needs ``file_path, line``; ``total`` and ``last`` are structs of the counter fields.
    """
    return previous_total(df, total, block=block).withColumn(out, usage_of(total, last)).drop("_previous")


def carry_forward(df: DataFrame, columns: Sequence[str], block: int | None = None) -> DataFrame:
    """Each column filled with its last non-null value in the file."""
    filled = carry_along(df, {f"_filled_{c}": Carry(F.col(c), own=True) for c in columns}, block=block)
    return filled.withColumns({c: F.col(f"_filled_{c}") for c in columns}).drop(*(f"_filled_{c}" for c in columns))


def resolve_fallback_model(df: DataFrame, model: str = "model", is_usage: str = "is_usage", date: str = "event_date", block: int | None = None) -> DataFrame:
    """``resolved_model, is_fallback`` for rows that state a model or use the one stated before.

    ``is_usage`` marks usage rows; others only state a model. ``date`` is the usage row's date
    as text. A row before any stated model has the fallback model, flagged. The review model
    is replaced by date on the first usage row after it is stated, which is flagged; later
    rows inherit the replacement without a flag. With ``block`` a file of many lines is
    resolved by many tasks; rows with what is near them then stand in the shared folder.
    """
    used, dated = F.col(is_usage), F.when(F.col(is_usage) & F.col(date).isNotNull(), F.struct("line", F.col(date).alias("date")))
    states = F.when(F.coalesce(F.col(model), F.lit("")) != "", F.struct("line", F.col(model).alias("model")))
    near = {
        "_stated": Carry(states, own=True),
        "_next_stated": Carry(states, back=True),
        "_used": Carry(F.when(used, F.struct("line"))),
        "_dated": Carry(dated),
        "_next_dated": Carry(dated, own=True, back=True),
    }
    out = carry_along(df, near, block=block)
    start = F.col("_stated.line")
    # The first dated usage since the model was stated is the row's own, one before it, or the next one before another model.
    since = lambda c: F.col(f"{c}.line").isNotNull() & (start.isNull() | (F.col(f"{c}.line") >= start))
    first_here = dated.isNotNull() & ~since("_dated")
    if block:  # read by two branches of the next scan
        out = staged(out, "models-near")
    out = carry_along(out, {"_first": Carry(F.when(first_here, F.struct("line", F.col(date).alias("date"))), own=True)}, block=block)
    ahead = F.when(F.col("_next_stated").isNull() | (F.col("_next_dated.line") < F.col("_next_stated.line")), F.col("_next_dated.date"))
    first_date = F.coalesce(F.when(since("_first"), F.col("_first.date")), ahead)
    none, review = start.isNull(), F.coalesce(F.col("_stated.model") == REVIEW_MODEL, F.lit(False))
    resolved = F.when(none, FALLBACK_MODEL).when(review, F.when(F.substring(first_date, 1, 10) >= REVIEW_SINCE, REVIEW_TARGET).otherwise(FALLBACK_MODEL)).otherwise(F.col("_stated.model"))
    flagged = none | (review & used & ~since("_used"))
    return out.withColumns({"resolved_model": resolved, "is_fallback": F.coalesce(flagged, F.lit(False))}).drop(*near, "_first")


def drop_fork_replay(snapshots: DataFrame, forks: DataFrame) -> DataFrame:
    """Snapshots without what a forked session repeats of its parent.

    ``snapshots``: ``file_path, line, home, session_id, at, snapshot`` (every counter row, in
    file order). ``forks``: ``file_path, home, parent_id, fork_at`` of forked files. A child's
    longest run of first snapshots that equals, one by one, the parent's snapshots dated up to
    the fork goes. If the parent is missing nothing goes.
    """
    by_file = Window.partitionBy("file_path").orderBy("line")
    numbered = snapshots.withColumn("_ordinal", F.row_number().over(by_file))
    parent = snapshots.select("home", F.col("session_id").alias("parent_id"), F.col("at").alias("_at"), F.col("line").alias("_line"), F.col("snapshot").alias("_parent"))
    theirs = forks.join(parent, ["home", "parent_id"]).filter(F.col("_at") <= F.col("fork_at"))
    theirs = theirs.withColumn("_ordinal", F.row_number().over(Window.partitionBy("file_path").orderBy("_line"))).select("file_path", "_ordinal", "_parent")
    met = numbered.join(theirs, ["file_path", "_ordinal"], "left")
    differs = ~F.coalesce(F.col("snapshot") == F.col("_parent"), F.lit(False))
    first = F.min(F.when(differs, F.col("_ordinal"))).over(Window.partitionBy("file_path"))
    return met.withColumn("_first", first).filter(F.col("_ordinal") >= F.col("_first")).drop("_ordinal", "_parent", "_first")


def lag_duplicates(events: DataFrame, totals: DataFrame, source_id: str = "codex-cli", order_id: str = "arrival") -> DataFrame:
    """Events without rows that repeat the row before them in their file.

    Candidates have the model and all five counts of the row before; they go only if the raw
    totals at both lines (``file_path, line, total``) are there and equal.
    """
    from ..schema import TOKENS

    own = events.filter(F.col("source_id") == source_id)
    order = Window.partitionBy("source_file_path").orderBy(F.coalesce("source_file_line", F.lit(2147483647)), order_id)
    same = F.struct("model_raw", *TOKENS)
    marked = own.select(order_id, "source_file_path", "source_file_line", F.lag("source_file_line").over(order).alias("_line"), (F.lag(same).over(order) == same).alias("_same"))
    found = marked.filter("_same AND source_file_line IS NOT NULL AND _line IS NOT NULL")
    a = totals.select(F.col("file_path").alias("source_file_path"), F.col("line").alias("source_file_line"), F.col("total").alias("_a"))
    b = totals.select(F.col("file_path").alias("source_file_path"), F.col("line").alias("_line"), F.col("total").alias("_b"))
    sure = found.join(a, ["source_file_path", "source_file_line"]).join(b, ["source_file_path", "_line"]).filter("_a = _b")
    return events.join(sure.select(order_id), order_id, "left_anti")
