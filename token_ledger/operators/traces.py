"""Trace context and precedence between kinds of record of one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trace_context(df: DataFrame) -> DataFrame:
    """``file_path, trace_id, model, session_id`` from ``file_path, trace_id, line, model, session_id, session_priority``.

    The first model in file order; the session attribute of highest priority, the earliest on
    a tie. Rows without a trace have no context.
    """
    model = F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line")))
    session = F.max_by("session_id", F.when(F.col("session_id").isNotNull(), F.struct("session_priority", (-F.col("line")).alias("first"))))
    return df.filter("trace_id IS NOT NULL").groupBy("file_path", "trace_id").agg(model.alias("model"), session.alias("session_id"))


def source_precedence(df: DataFrame, rank: str = "kind_rank") -> DataFrame:
    """Rows that no row of a better (lower) rank shares a trace or a response id with, inside their file.

    Null ids meet nothing.
    """
    best = lambda c: F.when(F.col(c).isNotNull(), F.min(rank).over(Window.partitionBy("file_path", c)))
    out = df.withColumns({"_trace": best("trace_id"), "_response": best("response_id")})
    keep = (F.coalesce(F.col("_trace"), F.col(rank)) >= F.col(rank)) & (F.coalesce(F.col("_response"), F.col(rank)) >= F.col(rank))
    return out.filter(keep).drop("_trace", "_response")
