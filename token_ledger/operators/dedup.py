"""One row for each (source, key), and what an upsert changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as K

KEYS = ("source_id", "dedup_key")


def _rank(arrival: str) -> list[Column]:
    """Non-replay first, then more tokens, then the earlier arrival."""
    return [F.coalesce("is_sidechain_replay", F.lit(False)).asc(), K.total().desc(), F.col(arrival).asc()]


def dedup_events(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The winner of each (source, key). One sort inside each key; keys repeat a few times, so no key is hot."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*_rank(arrival)))).filter("_n = 1").drop("_n")


def upsert_sides(existing: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """All rows of ``existing`` and the winners of ``incoming`` with their ``_side``: 0 stands as it stood, 1 is new, -1 has been replaced.

    A winner replaces the whole row, a tie keeps the existing one; only keys that come in are
    ranked again. Rows move once, to their keys.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = [*_rank(arrival)[:2], F.col("_new").asc(), F.col(arrival).asc()]
    none = F.when(F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull(), F.col("_new"))  # rows without a key meet none of the other side
    own = Window.partitionBy(*KEYS, "_none")
    ranked = both.withColumn("_none", none).withColumn("_n", F.row_number().over(own.orderBy(*order))).withColumn("_met", F.max("_new").over(own))
    old = F.when((F.col("_met") == 1) & (F.col("_n") > 1), -1).otherwise(0)
    return ranked.withColumn("_side", F.when(F.col("_new") == 0, old).otherwise(1)).filter("_new = 0 OR _n = 1").drop("_new", "_none", "_n", "_met")


def upsert_events(existing: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """``existing`` with ``incoming`` merged in: a winner replaces the whole row, a tie keeps the existing one.

    Only keys that come in are ranked again; the rest of the store passes through.
    """
    return upsert_sides(existing, incoming, arrival).filter("_side >= 0").drop("_side")


def reset_files(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events without those of the given ``file_path`` rows."""
    return events.join(files.select(F.col("file_path").alias("source_file_path")), "source_file_path", "left_anti")


def changed_days(sides: DataFrame) -> DataFrame:
    """``day_utc, changes`` of rows with a ``_side``: 1 for a row that has come, -1 for one that has gone; equal ones on both sides are no change."""
    row = F.xxhash64(*sorted(c for c in sides.columns if c != "_side")).alias("_row")
    one = sides.filter("_side != 0").select(F.to_date("timestamp_utc").alias("day_utc"), row, "_side")
    return one.groupBy("day_utc", "_row").agg(F.sum("_side").alias("_d")).filter("_d != 0").groupBy("day_utc").agg(F.sum(F.abs("_d")).alias("changes"))


def touched_days(before: DataFrame, after: DataFrame) -> DataFrame:
    """``day_utc, changes``: days that lost or gained a row; a replacement touches the old and the new day."""
    cols = [c for c in before.columns if c in after.columns]
    side = lambda df, n: df.select(*cols).withColumn("_side", F.lit(n))
    return changed_days(side(before, -1).unionByName(side(after, 1)))
