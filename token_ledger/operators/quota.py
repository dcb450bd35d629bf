"""Quota payloads (landed JSON) to window rows, and the state kept of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that payloads use.
PERCENT_KEYS = ("utilization", "used_percent", "usedPercent", "percent_used", "percentUsed", "percent")
FRACTION_KEYS = ("used_fraction", "usedFraction")
USED_KEYS = ("used", "used_tokens", "usedTokens", "current_usage", "currentUsage")
LIMIT_KEYS = ("limit", "max", "capacity", "total", "quota")
RESET_KEYS = ("resets_at", "reset_at", "resetsAt", "reset_time", "resetTime")
RESET_IN_KEYS = ("resets_in_seconds", "reset_after_seconds", "resetsInSeconds", "seconds_until_reset", "secondsUntilReset")
#: Window ids at the top of a payload, and under ``rate_limit``.
WINDOWS = ("five_hour", "seven_day", "seven_day_opus", "seven_day_sonnet")
NESTED_WINDOWS = ("primary_window", "secondary_window")


def _first(window: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(window[k].try_cast("double") for k in keys))


def used_fraction(window: Column) -> Column:
    """0 to 1 from a map of a window's values: a percentage, a fraction, or used over limit; null if it tells none."""
    ratio = F.when(_first(window, LIMIT_KEYS) > 0, _first(window, USED_KEYS) / _first(window, LIMIT_KEYS))
    value = F.coalesce(_first(window, PERCENT_KEYS) / 100, _first(window, FRACTION_KEYS), ratio)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def resets_at(window: Column, fetched_at: Column) -> Column:
    """The reset time: a time, seconds of the epoch, or seconds from the fetch."""
    absolute = [F.coalesce(F.try_to_timestamp(window[k]), F.when(window[k].try_cast("double") > 0, F.timestamp_micros((window[k].try_cast("double") * 1e6).cast("bigint")))) for k in RESET_KEYS]
    later = F.timestamp_micros(F.unix_micros(fetched_at.cast("timestamp")) + (_first(window, RESET_IN_KEYS) * 1e6).cast("bigint"))
    return F.coalesce(*absolute, later)


def quota_windows(payloads: DataFrame) -> DataFrame:
    """``source_id, fetched_at, window_id, used_fraction, resets_at`` from ``source_id, fetched_at, payload``.

    Windows that are not known, or tell no usage, give no row.
    """
    one = F.from_json("payload", "map<string,string>")
    two = F.from_json(one["rate_limit"], "map<string,string>")
    entries = F.array(*(F.struct(F.lit(w).alias("window_id"), one[w].alias("body")) for w in WINDOWS), *(F.struct(F.lit(w).alias("window_id"), two[w].alias("body")) for w in NESTED_WINDOWS))
    rows = payloads.select("source_id", "fetched_at", F.explode(entries).alias("w")).select("source_id", "fetched_at", "w.window_id", F.from_json("w.body", "map<string,string>").alias("_w"))
    return rows.select("source_id", "fetched_at", "window_id", used_fraction(F.col("_w")).alias("used_fraction"), resets_at(F.col("_w"), F.col("fetched_at")).alias("resets_at")).filter("used_fraction IS NOT NULL")


RATE_LIMITED = "HTTP 429"


def quota_state(snapshots: DataFrame) -> DataFrame:
    """Newest state of each source from ``source_id, fetched_at, status, detail, windows, tier``.

    A rate-limited snapshot shows the last good one's windows. The tier is the stored one, or
    ``free`` if the primary window is the only one.
    """
    order = Window.partitionBy("source_id").orderBy("fetched_at")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    good = F.last(F.when(F.col("status") == "ok", F.struct("windows", F.col("fetched_at").alias("at"))), ignorenulls=True).over(until)
    newest = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("fetched_at")))
    limited = (F.col("status") != "ok") & (F.col("detail") == RATE_LIMITED) & F.col("_good").isNotNull()
    out = snapshots.withColumns({"_good": good, "_n": newest}).filter("_n = 1")
    windows = F.when(limited, F.col("_good.windows")).when(F.col("status") == "ok", F.col("windows"))
    only_primary = (F.size(windows) == 1) & (windows[0] == "primary_window")
    return out.select(
        "source_id", F.when(limited, F.lit("ok")).otherwise(F.col("status")).alias("status"), F.when(limited, F.col("_good.at")).otherwise(F.col("fetched_at")).alias("shown_at"), windows.alias("windows"), F.coalesce("tier", F.when(only_primary, F.lit("free"))).alias("tier")
    )
