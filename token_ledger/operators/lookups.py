"""Joins of records with what stands beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger_cache_join(ledger: DataFrame, messages: DataFrame) -> DataFrame:
    """Ledger events with the cache counts of their message; the last message of an id wins, none gives 0.

    ``ledger``: ``file_path, message_id, …``; ``messages``: ``file_path, message_id, position,
    cache_create, cache_read``. Both grow with the logs, and what Spark estimates for columns
    read out of JSON is far too small, so the join is told to sort both sides.
    """
    last = messages.groupBy("file_path", "message_id").agg(F.max_by(F.struct("cache_create", "cache_read"), "position").alias("_c"))
    out = ledger.join(last.hint("merge"), ["file_path", "message_id"], "left")
    return out.withColumns({c: F.coalesce(F.col(f"_c.{c}"), F.lit(0).cast("bigint")) for c in ("cache_create", "cache_read")}).drop("_c")


def sidecar_join(rows: DataFrame, sidecar: DataFrame, key: str, value: str, line: str = "line", most_lines: int = 500) -> DataFrame:
    """``rows`` with the first non-empty ``value`` among a sidecar's first lines; sidecars grow with the rows and are not broadcast."""
    first = sidecar.filter((F.col(line) < most_lines) & (F.coalesce(F.col(value), F.lit("")) != "")).groupBy(key).agg(F.min_by(value, line).alias(value))
    return rows.join(first.hint("merge"), key, "left")


def device_usage_join(usage: DataFrame, devices: DataFrame) -> DataFrame:
    """Usage with its device's name; rows without a device, or of an unknown one, go."""
    return usage.join(devices.select("device_id", "device_name"), "device_id")


def descriptor_join(totals: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Totals of known sources in their order, without sources that did nothing."""
    return totals.join(descriptors, "source_id").filter("event_count > 0 OR total_tokens > 0").orderBy("sort_order", "source_id")
