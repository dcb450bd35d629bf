"""Tolerant look-ups in parsed JSON (VARIANT) and tolerant dates.

A line is parsed once with ``parse``; each look-up takes the first of several paths that
yields a value. Numbers may be strings and strings numbers, as agents write them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def parse(value: Column) -> Column:
    """The parsed value; null for a line that is not JSON."""
    return F.try_parse_json(value)


def parsed(rows: DataFrame, column: str = "value") -> DataFrame:
    """``rows`` with ``column`` as the parsed value ``v``; rows that are not JSON go.

    The value is exploded out of an array of one: filters on what it holds then stay above
    it. Through a plain projection the optimizer would push them down with a parse in each.
    """
    return rows.select(*(c for c in rows.columns if c != column), F.explode(F.array(parse(F.col(column)))).alias("v")).filter("v IS NOT NULL")


def taken(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns read out of ``v``, which goes; filters on them read the columns, not ``v`` again."""
    others = [c for c in rows.columns if c != "v"]
    return rows.select(*others, *(c.alias(n) for n, c in columns.items())).select(*others, F.inline(F.array(F.struct(*columns))))


def members(rows: DataFrame, **objects: Column) -> DataFrame:
    """``rows`` with the members of objects as maps of values, each built once.

    ``at`` looks one up there, whereas a path into ``v`` searches the object once more for every
    look-up. What is no object has no members.
    """
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*(F.try_variant_get(c, "$", "map<string,variant>").alias(n) for n, c in objects.items())))))


def at(members: Column | str, name: str) -> Column:
    """A member as a value; null if there is none."""
    return F.try_element_at(members, F.lit(name))


def first(read: Callable[..., Column], members: Column | str, *names: str) -> Column:
    """What ``read`` (``text``, ``integer``, ``number``) finds in the first of several members that holds any."""
    return F.coalesce(*(read(at(members, n), "$") for n in names))


def filled(c: Column | str) -> Column:
    """The trimmed string; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def path(*keys: str) -> str:
    """A path from keys that may hold dots."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def _get(v: Column | str, p: str, kind: str) -> Column:
    return F.try_variant_get(v, p if p.startswith("$") else path(*p.split(".")), kind)


def text(v: Column | str, *paths: str) -> Column:
    """First non-empty trimmed string."""
    return F.coalesce(*(filled(_get(v, p, "string")) for p in paths))


def raw_text(v: Column | str, p: str) -> Column:
    """The string as it is, which may be empty."""
    return _get(v, p, "string")


def integer(v: Column | str, *paths: str) -> Column:
    """First whole number: exact, a truncated fraction, or a numeric string."""
    return F.coalesce(*(_get(v, p, "bigint") for p in paths))


def count(v: Column | str, *paths: str) -> Column:
    return F.coalesce(integer(v, *paths), F.lit(0).cast("bigint"))


def number(v: Column | str, *paths: str) -> Column:
    return F.coalesce(*(_get(v, p, "double") for p in paths))


def money(v: Column | str, *paths: str) -> Column:
    return F.coalesce(*(_get(v, p, "decimal(30,12)") for p in paths))


def flag(v: Column | str, p: str) -> Column:
    return F.coalesce(_get(v, p, "boolean"), F.lit(False))


def has(v: Column | str, p: str) -> Column:
    """Whether the path holds anything but null."""
    return _get(v, p, "variant").isNotNull() & ~F.coalesce(F.is_variant_null(_get(v, p, "variant")), F.lit(True))


def items(v: Column | str, p: str) -> Column:
    """The array at a path; null if there is none."""
    return _get(v, p, "array<variant>")


def iso_time(s: Column) -> Column:
    """Time of an ISO-8601 string with date, time and zone; null for anything else."""
    return F.when(s.rlike(ISO), F.try_to_timestamp(s))


def epoch_time(n: Column, milli_from: float = 1e10) -> Column:
    """Time of seconds, or of milliseconds above a limit."""
    micros = F.when(n > milli_from, n * 1e3).otherwise(n * 1e6)
    return F.timestamp_micros(F.round(micros).cast("bigint"))


def time(v: Column | str, *paths: str) -> Column:
    """First value that is an ISO time, or seconds or milliseconds."""
    return F.coalesce(*(F.coalesce(iso_time(F.trim(_get(v, p, "string"))), epoch_time(_get(v, p, "double"))) for p in paths))


def magnitude_time(n: Column) -> Column:
    """Time of s, ms, us or ns, told apart by size."""
    micros = F.when(n >= 1e17, n / 1e3).when(n >= 1e14, n).when(n >= 1e11, n * 1e3).otherwise(n * 1e6)
    return F.when(n > 0, F.timestamp_micros(F.round(micros).cast("bigint")))


def parts_time(v: Column | str, p: str) -> Column:
    """Time of ``[seconds, nanoseconds]``."""
    return pair_time(_get(v, p, "array<double>"))


def pair_time(pair: Column) -> Column:
    """Time of an array of seconds and nanoseconds."""
    return F.when(F.size(pair) >= 2, F.timestamp_micros(F.round(F.get(pair, F.lit(0)) * 1e6 + F.get(pair, F.lit(1)) / 1e3).cast("bigint")))


def plain_time(s: Column) -> Column:
    """Time of ISO, ``yyyy-MM-dd HH:mm:ss`` (blank or T) or a bare date, as UTC."""
    return F.coalesce(iso_time(s), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(F.replace(s, F.lit("T"), F.lit(" ")))), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s)))
