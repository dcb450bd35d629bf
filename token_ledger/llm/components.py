"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import staged


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node of the component) of every node in ``src, dst`` that has a link.

    In a round every node hooks to its smallest neighbour, if that is smaller, follows one
    step further, and the edges are contracted: both ends become what they hooked to, loops
    and repeats go. Only what is still to be joined goes into the next round; at least every
    second round halves the nodes that have edges. A hub's links are aggregated before they
    are shuffled. Each round is written to the shared folder, which cuts lineage.
    """
    one = F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    edges = staged(edges.select(*one).filter("src != dst").distinct(), f"{name}-edges-0")
    labels = None
    for n in range(1, max_rounds + 1):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = staged(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("parent")), f"{name}-hooks-{n}")
        hooks = staged(hooks.join(hooks.select(F.col("node").alias("parent"), F.col("parent").alias("root")), "parent").select("node", "root"), f"{name}-roots-{n}")
        if labels is None:
            labels = hooks.withColumnRenamed("root", "component")
        else:
            moved = labels.join(hooks.withColumnRenamed("node", "component"), "component", "left")
            labels = staged(moved.select("node", F.coalesce("root", "component").alias("component")), f"{name}-labels-{n}")
        ends = edges.join(hooks.select(F.col("node").alias("src"), F.col("root").alias("a")), "src").join(hooks.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst")
        edges = staged(ends.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).filter("src != dst").distinct(), f"{name}-edges-{n}")
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"edges are left after {max_rounds} rounds")
