"""Exact duplicate removal with skew-safe combining, in DataFrame operations only.

A text is combined three times: inside each input task (map-side combine), inside each
salted digest group, and once more over the salt winners. Every stage groups by the digest
and the whole text, so texts are equal only if their contents are; the digest spreads the
rows. A group that holds a third of all rows reaches the last stage as at most ``salts``
rows. Verdicts go back to the rows over (digest, salt), where one key holds at most about
1/``salts`` of a group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import staged

#: Salt winners are noted as bits of one long.
MOST_SALTS = 62


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 48, normalize=None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of rows with equal text the largest id stays. A null text is an empty one; empty texts
    are copies of each other. Rows that repeat an id and a text are all returned, with the
    same verdict, and each counts in ``group_size``. A null id never wins over another id; a
    group of null ids only keeps its rows. Other columns of ``df`` are not read. An empty
    table gives an empty result. ``normalize`` is an optional Column -> Column function.
    """
    if not 1 <= salts <= MOST_SALTS:
        raise ValueError(f"salts must be 1 to {MOST_SALTS}")
    clean = normalize or (lambda c: c)
    rows = df.select(F.col(id_col).alias("id"), clean(F.coalesce(F.col(text_col), F.lit(""))).alias("body")).select(
        "id", "body", F.sha2("body", 256).alias("digest"), _salt(F.col("id"), salts).alias("salt")
    )
    # Map-side combine makes this one row for each text, salt and task before the shuffle.
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "body").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.expr("bit_or(shiftleft(1L, salt))").alias("salt_bits")
    )
    verdicts = staged(winners.drop("body"), "exact-dedup")
    light = rows.select("id", "digest", "salt")
    if verdicts.groupBy("digest").count().filter("count > 1").isEmpty():
        out = _spread(light, verdicts, salts)
    else:  # different contents share a digest: those rows are told apart by their text
        shared = verdicts.groupBy("digest").count().filter("count > 1").select("digest")
        told = rows.join(shared, "digest", "left_semi").join(winners, ["digest", "body"]).select("id", "digest", "keep_id", "group_size")
        rest = _spread(light.join(shared, "digest", "left_anti"), verdicts.join(shared, "digest", "left_anti"), salts)
        out = rest.unionByName(told)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 48) -> DataFrame:
    """The rows of ``df`` that stay, one for each distinct text, with all their columns.

    The same stages as ``exact_dedup``, but the winner travels as a whole row and nothing is
    joined back. The row of the largest id stays (a null id only if there is no other); of
    rows that repeat id and text, that whose columns have the largest hash, so the result
    does not depend on row order. Nulls and empty texts are one text; the row keeps which it
    has. Any other columns may be there, of any names. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    # Maps and variants have no hash of their own.
    told = (F.to_json(F.struct(F.col(f"`{c}`"))) if re.search(r"\b(map<|variant\b)", kind) else F.col(f"`{c}`") for c, kind in df.dtypes)
    order = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(*told).alias("tie")).alias("order")
    rows = df.select(F.sha2(body, 256).alias("digest"), body.alias("body"), row, order)
    salted = rows.groupBy("digest", F.pmod(F.col("order.tie"), F.lit(salts)).alias("salt"), "body").agg(F.max_by("row", "order").alias("row"), F.max("order").alias("order"))
    return salted.groupBy("digest", "body").agg(F.max_by("row", "order").alias("row")).select("row.*")


def _salt(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def _spread(rows: DataFrame, verdicts: DataFrame, salts: int) -> DataFrame:
    """Verdicts joined to rows on (digest, salt), one verdict row for each salt that a group has."""
    each = verdicts.select(
        "digest", "keep_id", "group_size", F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("salt_bits", s) == 1)).alias("salt")
    )
    return rows.join(each, ["digest", "salt"]).select("id", "digest", "keep_id", "group_size")
