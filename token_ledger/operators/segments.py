"""Scans along an order that part a long sequence over many tasks.

A window over a key sorts all rows of the key in one task. Here a key's rows are cut into
blocks of the order; each block is summed up in one row, a running value goes over the
summaries, and the blocks are finished side by side with what comes from before them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the order in a block.
BLOCK = 200_000


@dataclass(frozen=True)
class Carry:
    """The nearest non-null ``value`` on one side of each row; ``own``: the row itself counts; ``back``: the side after it."""

    value: Column
    own: bool = False
    back: bool = False


def carry_along(df: DataFrame, carries: dict[str, Carry], keys: Sequence[str] = ("file_path",), order: str = "line", block: int | None = BLOCK) -> DataFrame:
    """``df`` with a column for each carry, over rows of equal ``keys`` by ``order``.

    ``order`` is a number, unique in its key; a block is a range of ``block`` of it. Without
    ``block`` each key is scanned in one task. Rows move once, to their blocks; what goes over
    a whole key is one row for each block.
    """
    df = df.withColumns({f"_v_{name}": c.value for name, c in carries.items()})
    at = [*keys, "_block"] if block else list(keys)
    if block:
        df = df.withColumn("_block", F.floor(F.col(order) / block))

    def along(by: Sequence[str], o: Sequence[str], c: Carry, own: bool):
        side = Window.partitionBy(*by).orderBy(*(F.desc(x) if c.back else F.asc(x) for x in o))
        return side.rowsBetween(Window.unboundedPreceding, 0 if own else -1)

    inside = {f"_in_{name}": F.last(f"_v_{name}", ignorenulls=True).over(along(at, ["_edge", order] if block else [order], c, c.own)) for name, c in carries.items()}
    if not block:
        return df.withColumns(inside).withColumnsRenamed({f"_in_{n}": n for n in carries}).drop(*(f"_v_{n}" for n in carries))
    ends = []
    for name, c in carries.items():
        place = F.when(F.col(f"_v_{name}").isNotNull(), F.col(order))
        ends.append((F.min_by if c.back else F.max_by)(f"_v_{name}", place).alias(f"_end_{name}"))
    summaries = df.groupBy(*at).agg(*ends)
    before = {f"_from_{name}": F.last(f"_end_{name}", ignorenulls=True).over(along(keys, ["_block"], c, False)) for name, c in carries.items()}
    summaries = summaries.withColumns(before).filter(reduce(or_, (F.col(c).isNotNull() for c in before)))
    # What comes from other blocks stands at a block's ends as rows of it; a file of one block has none.
    edge = lambda place, back: F.struct(F.lit(place).alias("_edge"), *(F.when(F.lit(c.back == back), F.col(f"_from_{n}")).alias(f"_v_{n}") for n, c in carries.items()))
    edges = summaries.select(*at, F.inline(F.array(edge(0, False), edge(2, True))))
    rows = df.withColumn("_edge", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    out = rows.withColumns(inside).filter("_edge = 1").withColumnsRenamed({f"_in_{n}": n for n in carries})
    return out.drop("_block", "_edge", *(f"_v_{n}" for n in carries))


def number_rows(df: DataFrame, blocks: str, order: str, keys: Sequence[str] = ("file_path",)) -> DataFrame:
    """``df`` with ``row``, from 0 along each key, where ``blocks`` part a key in order and ``order``, never null, sorts a block."""
    at = [*keys, blocks]
    counts = df.groupBy(*at).agg(F.count(order).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(blocks)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(order)).cast("bigint") - 1
    return df.withColumn("_in", inside).join(counts.select(*at, before.alias("_before")), at).withColumn("row", F.col("_before") + F.col("_in")).drop("_in", "_before")
