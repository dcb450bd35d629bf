"""Counters of growing files as DataFrame work in each micro-batch, with a few rows of each file as state.

What later lines of a file depend on is held as rows of it: the last that told a total, the
last that stated a model, and the first uses since. A batch is scanned together with these
rows by the operators that scan whole files, so a file may come in any number of parts, and
one that is huge within a batch goes over many tasks (``block``). Nothing runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counters import COUNTER_FIELDS, drop_fork_replay, previous_total, resolve_fallback_model, usage_of
from ..plans import storage
from ..session import staged

_COUNTS = "struct<" + ",".join(f"{f}:bigint" for f in COUNTER_FIELDS) + ">"
CARRIED = f"file_path string, line bigint, total {_COUNTS}, model string, is_usage boolean, event_date string, part string, seen timestamp"
SHOTS = "file_path string, line bigint, home string, session_id string, at timestamp, snapshot string"
FORKS = "file_path string, home string, parent_id string, fork_at timestamp"
_ROW = ("file_path", "line", "model", "is_usage", "event_date")


def counters_step(new: DataFrame, carried: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(usage rows, what to carry on) of new lines, given what was carried from earlier ones.

    ``new``: ``file_path, line, seen`` (a time), ``total, last`` (structs of the counter
    fields), ``model, is_usage, event_date``; rows that are no usage only state a model. Gives
    ``file_path, line, usage, resolved_model, is_fallback`` of rows with usage; rows that
    repeat the last total have none and state no model. Use of the review model is dated by
    the first use with a date up to the end of the batch.
    """
    totals = new.filter("is_usage").select(*_ROW, "total", "last", F.lit(True).alias("_new"))
    held = carried.filter("part = 'total'").select(*_ROW, "total", F.lit(None).cast(_COUNTS).alias("last"), F.lit(False).alias("_new"))
    counted = staged(previous_total(totals.unionByName(held), block=block), "counters-totals")
    fresh = counted.filter("_new AND NOT coalesce(total = _previous, false)").withColumn("usage", usage_of()).filter("usage IS NOT NULL").select(*_ROW, "usage", "_new")
    stated = new.filter("NOT is_usage AND coalesce(model, '') <> ''").select(*_ROW, F.lit(None).cast(_COUNTS).alias("usage"), F.lit(True).alias("_new"))
    known = carried.filter("part = 'model'").select(*_ROW, F.lit(None).cast(_COUNTS).alias("usage"), F.lit(False).alias("_new"))
    resolved = staged(resolve_fallback_model(fresh.unionByName(stated).unionByName(known), block=block), "counters-models")
    out = resolved.filter("_new AND is_usage").select("file_path", "line", "usage", "resolved_model", "is_fallback")

    seen = new.select("file_path", "seen").unionByName(carried.select("file_path", "seen")).groupBy("file_path").agg(F.max("seen").alias("seen"))
    none = F.lit(None).cast("string")
    last = counted.filter("total IS NOT NULL").groupBy("file_path").agg(F.max("line").alias("line"), F.max_by("total", "line").alias("total"))
    last = last.select("file_path", "line", "total", none.alias("model"), F.lit(True).alias("is_usage"), none.alias("event_date"), F.lit("total").alias("part"))
    states = F.coalesce("model", F.lit("")) != ""
    since = resolved.groupBy("file_path").agg(F.max(F.when(states, F.col("line"))).alias("_at"))
    use = resolved.join(since, "file_path").filter(F.col("_at").isNull() | (F.col("line") >= F.col("_at")))
    row = F.struct("line", "model", "is_usage", "event_date")
    firsts = (F.min(F.when(F.col("line") == F.col("_at"), row)), F.min(F.when(F.col("is_usage"), row)), F.min(F.when(F.col("is_usage") & F.col("event_date").isNotNull(), row)))
    models = use.groupBy("file_path").agg(F.array_compact(F.array_distinct(F.array(*firsts))).alias("rows"))
    models = models.select("file_path", F.inline("rows")).select("file_path", "line", F.lit(None).cast(_COUNTS).alias("total"), "model", "is_usage", "event_date", F.lit("model").alias("part"))
    return out, last.unionByName(models).join(seen, "file_path")


def _newest(spark: SparkSession, place: str, before: int) -> int | None:
    numbers = [int(n) for n in storage.names(spark, place) if n.isdigit() and int(n) < before]
    return max(numbers, default=None)


def _alive(carried: DataFrame, lifetime: str | None) -> DataFrame:
    """Files seen within a lifetime of the newest."""
    newest = carried.agg(F.max("seen")).first()[0]
    files = carried.groupBy("file_path").agg(F.max("seen").alias("seen"))
    return (files if lifetime is None or newest is None else files.filter(F.col("seen") >= F.lit(newest) - F.expr(f"INTERVAL {lifetime}"))).select("file_path")


def stream_counters(rows: DataFrame, sink: Callable[[DataFrame, int], None], place: str, checkpoint: str, lifetime: str | None = None, block: int | None = None, interval: str = "10 seconds", available_now: bool = False) -> StreamingQuery:
    """Counter deltas, models and fork replays over a stream of counter rows; usage goes to ``sink(usage, batch)``.

    ``rows`` are as ``counters_step`` takes them, with ``home, session_id`` and, on a forked
    file's first row, ``parent_id, fork_at``. What a child repeats of its parent goes if the
    parent's rows came in the same batch or before. State stands in ``place``, a folder for
    each batch, so a batch that runs again starts from the state that it started from before;
    the sink gets the number of the batch, to write it once. With a ``lifetime`` ('7 days',
    against the newest ``seen``) files and parents that have had no line for so long leave
    the state; a line that comes later yet is taken as a file's first.
    """
    spark = rows.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        new = staged(batch, "counters-batch")
        before = _newest(spark, f"{place}/carried", number)
        held = {name: spark.read.schema(schema).parquet(f"{place}/{name}/{before}") if before is not None else spark.createDataFrame([], schema) for name, schema in (("carried", CARRIED), ("shots", SHOTS), ("forks", FORKS))}
        usage, carried = counters_step(new, held["carried"], block)
        snapshot = F.concat_ws("|", F.coalesce(F.to_json("total"), F.lit("")), F.coalesce(F.to_json("last"), F.lit("")))
        own = new.filter("is_usage AND (total IS NOT NULL OR last IS NOT NULL)").select("file_path", "line", "home", "session_id", F.col("seen").alias("at"), snapshot.alias("snapshot"))
        shots = staged(held["shots"].unionByName(own), "counters-shots")
        forks = staged(held["forks"].unionByName(new.filter("parent_id IS NOT NULL").select("file_path", "home", "parent_id", "fork_at")), "counters-forks")
        # Only files of this batch and their parents are compared.
        here = new.select("file_path").distinct()
        due = forks.join(here, "file_path", "left_semi")
        needed = shots.join(due.select("home", F.col("parent_id").alias("session_id")).distinct(), ["home", "session_id"], "left_semi").unionByName(shots.join(due.select("file_path"), "file_path", "left_semi")).distinct()
        fresh = drop_fork_replay(needed, due).select("file_path", "line")
        replayed = own.join(due.select("file_path"), "file_path", "left_semi").select("file_path", "line").join(fresh, ["file_path", "line"], "left_anti")
        sink(usage.join(replayed, ["file_path", "line"], "left_anti"), number)
        carried = staged(carried.select(held["carried"].columns), "counters-carried")
        files = staged(_alive(carried, lifetime), "counters-alive")
        for name, state in (("shots", shots), ("forks", forks), ("carried", carried)):  # the last makes the batch's state whole
            state.join(files, "file_path", "left_semi").write.mode("overwrite").parquet(f"{place}/{name}/{number}")
        for old in [int(n) for n in storage.names(spark, f"{place}/carried") if n.isdigit() and before is not None and int(n) < before]:
            for name in ("carried", "shots", "forks"):
                storage.delete(spark, f"{place}/{name}/{old}")

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
