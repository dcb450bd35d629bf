"""The common end of every scan: token fall-back, price, cost and flag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions.tokens import normalize_tokens
from ..operators.pricing import RATES, attach_price, cost_and_flag
from ..schema import MONEY, TOKENS

RAW = ("source_id", "dedup_key", "is_sidechain_replay", "timestamp_utc", "session_id", "project_or_workspace", "request_id", "model_raw", *TOKENS, "reported_cost", "source_file_path", "source_file_line")


def usage_rows(df: DataFrame, source_id: str, tokens: Mapping[str, Column], columns: Mapping[str, Column], total: Column | None = None, keep_costed: bool = False) -> DataFrame:
    """Raw usage rows of one agent: counts that are not given are 0, a reported total is the fall-back, rows without tokens go (``keep_costed``: unless they report a cost)."""
    zero = F.lit(0).cast("bigint")
    given = {t: F.coalesce(tokens.get(t.removesuffix("_tokens"), zero), zero).cast("bigint") for t in TOKENS}
    empty = {"is_sidechain_replay": F.lit(False), "project_or_workspace": F.lit(None).cast("string"), "request_id": F.lit(None).cast("string"), "reported_cost": F.lit(None).cast(MONEY), "source_file_line": F.lit(None).cast("bigint"), "source_file_path": F.col("file_path")}
    every = {"source_id": F.lit(source_id), **empty, **columns, **given, "reported_total": zero if total is None else F.coalesce(total, zero)}
    out = df.select(*(c.alias(n) for n, c in every.items() if n in RAW or n in ("reported_total", "is_fallback_model")))
    out = out.filter(F.col("timestamp_utc").isNotNull()).withColumn("reported_cost", F.col("reported_cost").cast(MONEY))
    costed = F.col("reported_cost").isNotNull() if keep_costed else F.lit(False)
    return normalize_tokens(out, keep=costed).drop("reported_total")


def priced(raw: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage events: raw rows with family, cost and flag."""
    rows = raw.withColumn("model_family", M.model_family(F.col("model_raw")))
    fallback = "is_fallback_model" if "is_fallback_model" in rows.columns else None
    return cost_and_flag(attach_price(rows, prices), fallback=fallback).drop(*RATES, "reported_cost", *([fallback] if fallback else []))
