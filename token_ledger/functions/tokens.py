"""Expressions on the five token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TOKENS


def total() -> Column:
    """All five counts."""
    return sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))


def cacheable_input() -> Column:
    return F.col("input_tokens") + F.col("cache_create_tokens") + F.col("cache_read_tokens")


def cache_read_ratio() -> Column:
    """Share of cacheable input that came from the cache; null without cache reads."""
    return F.when(F.col("cache_read_tokens") > 0, F.col("cache_read_tokens") / cacheable_input())


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), a - b)


def token_metrics(df: DataFrame) -> DataFrame:
    """``df`` with total_tokens, cacheable_input_tokens and cache_read_ratio."""
    return df.withColumns({"total_tokens": total(), "cacheable_input_tokens": cacheable_input(), "cache_read_ratio": cache_read_ratio()})


def normalize_tokens(df: DataFrame, total_col: str = "reported_total", keep: Column | None = None) -> DataFrame:
    """A reported total becomes output where all counts are 0; rows without any token go, but for those that ``keep`` names."""
    fallback = (total() == 0) & (F.coalesce(F.col(total_col), F.lit(0)) > 0)
    return df.withColumn("output_tokens", F.when(fallback, F.col(total_col).cast("bigint")).otherwise(F.col("output_tokens"))).filter(total() > 0 if keep is None else (total() > 0) | keep)
