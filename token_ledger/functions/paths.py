"""Parts of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column | str) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def after(path: Column | str, *folders: str, last: bool = False) -> Column:
    """Parts behind the first (or last) folder of one of these names; null if there is none."""
    p = parts(path)
    if last:
        back = F.reverse(p)
        at = F.least(*(F.nullif(F.array_position(back, f), F.lit(0)) for f in folders)) if len(folders) > 1 else F.nullif(F.array_position(back, folders[0]), F.lit(0))
        return F.reverse(F.slice(back, F.lit(1), at.cast("int") - 1))
    at = F.nullif(F.array_position(p, folders[0]), F.lit(0)).cast("int")
    return F.when(at.isNotNull(), F.slice(p, at + 1, F.size(p) - at))
