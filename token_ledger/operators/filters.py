"""Filters, day ranges and visible scopes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_day(ts: Column, tz: str = "UTC") -> Column:
    """The calendar day in a zone of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts, tz)) if tz != "UTC" else F.to_date(ts)


def filter_usage(df: DataFrame, sources: Sequence[str] = (), models: Sequence[str] = (), devices: Sequence[str] = (), start: dt.date | None = None, end: dt.date | None = None, tz: str = "UTC") -> DataFrame:
    """Rows in a range of local days and in optional lists; an empty list is no filter.

    A range of UTC times, wider by a day on both sides, stands beside the local-day filter,
    so that files and partitions can be pruned.
    """
    for column, values in (("source_id", sources), ("model_family", models), ("device_id", devices)):
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    day = local_day(F.col("timestamp_utc"), tz)
    if start is not None:
        df = df.filter((F.col("timestamp_utc") >= F.lit(str(start - dt.timedelta(days=1))).cast("timestamp")) & (day >= F.lit(start)))
    if end is not None:
        df = df.filter((F.col("timestamp_utc") < F.lit(str(end + dt.timedelta(days=2))).cast("timestamp")) & (day <= F.lit(end)))
    return df


def visible_scope(df: DataFrame, column: str, visible: Sequence[str] | None, requested: Sequence[str] = ()) -> DataFrame:
    """Rows of the visible and requested values. ``visible``: None is all, an explicit empty list is nothing."""
    if visible is None:
        return df.filter(F.col(column).isin(list(requested))) if requested else df
    allowed = [v for v in visible if not requested or v in requested]
    return df.filter(F.col(column).isin(allowed)) if allowed else df.limit(0)


def hide_sources(known: DataFrame, hidden: DataFrame) -> DataFrame:
    """Known sources without the hidden ones."""
    return known.join(hidden.select("source_id"), "source_id", "left_anti")


PRESETS = ("today", "yesterday", "last7", "last30", "last90", "this_week", "this_month")


def date_range(preset: str, today: Column) -> tuple[Column, Column]:
    """First and last day of a preset (or ``days:N``, N days back), both included. Weeks start on Monday."""
    back = lambda n: F.date_sub(today, n)
    if preset.startswith("days:"):
        return back(int(preset[5:])), today
    return {
        "today": (today, today),
        "yesterday": (back(1), back(1)),
        "last7": (back(6), today),
        "last30": (back(29), today),
        "last90": (back(89), today),
        "this_week": (F.to_date(F.date_trunc("week", today)), today),
        "this_month": (F.to_date(F.date_trunc("month", today)), today),
    }[preset]


def previous_range(start: Column, end: Column) -> tuple[Column, Column]:
    """The range of the same length that ends the day before."""
    days = F.datediff(end, start) + 1
    return F.date_sub(start, days), F.date_sub(start, F.lit(1))


ACTIVITY_DAYS = 168


def activity_range(today: Column) -> tuple[Column, Column]:
    """The fixed range of the activity calendar."""
    return F.date_sub(today, ACTIVITY_DAYS - 1), today
