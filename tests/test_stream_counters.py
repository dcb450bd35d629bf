"""Counters of files that come in parts, with state that ends and parents that came before."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from token_ledger.operators import counters as C
from token_ledger.session import configure
from token_ledger.streaming.counters import CARRIED, counters_step, stream_counters

from .test_segments import FIELDS, _rows

SCHEMA = f"file_path string, line bigint, total {FIELDS}, last {FIELDS}, model string, is_usage boolean, event_date string"


def _whole(df):
    """All lines at once, by the operators that scan files."""
    kept = C.previous_total(df.filter("is_usage")).filter("NOT coalesce(total = _previous, false)").withColumn("usage", C.usage_of()).filter("usage IS NOT NULL").drop("_previous")
    stated = df.filter("NOT is_usage AND coalesce(model, '') <> ''").withColumn("usage", F.lit(None).cast(FIELDS))
    out = C.resolve_fallback_model(kept.unionByName(stated)).filter("is_usage")
    return {(r["file_path"], r["line"]): (tuple(r["usage"]), r["resolved_model"], r["is_fallback"]) for r in out.collect()}


@pytest.mark.parametrize("seed, block", [(1, None), (2, 7)])
def test_parts_equal_the_whole(spark, seed, block):
    rows = [(*r[:6], r[6] or "2026-03-01" if r[5] else None) for r in _rows(seed, 60)]  # no batch can look ahead for a date
    df = configure(spark).createDataFrame(rows, SCHEMA).withColumn("seen", F.timestamp_seconds("line"))
    rng, got = random.Random(seed), {}
    cuts = [0, *sorted(rng.sample(range(1, 180), 3)), 1_000]
    carried = spark.createDataFrame([], CARRIED)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        usage, carried = counters_step(df.filter(F.col("line").between(lo, hi - 1)), carried, block)
        got |= {(r["file_path"], r["line"]): (tuple(r["usage"]), r["resolved_model"], r["is_fallback"]) for r in usage.collect()}
        carried = spark.createDataFrame(carried.select(*[c.split()[0] for c in CARRIED.split(", ")]).collect(), CARRIED)
        assert carried.count() <= 2 * 4
    assert got == _whole(df)


def test_state_ends_and_forks_outlive_batches(spark, tmp_path):
    spark = configure(spark)
    schema = f"{SCHEMA}, seen timestamp, home string, session_id string, parent_id string, fork_at timestamp"
    got = {}

    def row(file, line, day, total, parent=None):
        at = dt.datetime(2026, 3, day, 0, 0, line)
        return (file, line, (total, 0, 0, 0, total), None, "m", True, "2026-03-01", at, "h", file, parent, dt.datetime(2026, 3, 3) if parent else None)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        sink = lambda usage, n: got.update({(r["file_path"], r["line"]): r["usage"]["total"] for r in usage.collect()})
        stream_counters(stream, sink, f"file://{tmp_path}/state", f"file://{tmp_path}/check", lifetime="7 days", available_now=True).awaitTermination()

    def held(name):
        folder = max((tmp_path / "state" / name).iterdir(), key=lambda p: int(p.name))
        return {r["file_path"] for r in spark.read.parquet(str(folder)).collect()}

    arrive(row("parent", 0, 1, 10), row("parent", 1, 1, 30), row("old", 0, 1, 5))
    arrive(row("child", 0, 4, 10, "parent"), row("child", 1, 4, 30))  # repeats its parent, a batch later
    arrive(row("child", 2, 5, 35), row("parent", 2, 5, 31))
    assert got == {("parent", 0): 10, ("parent", 1): 20, ("old", 0): 5, ("child", 2): 5, ("parent", 2): 1}
    assert held("carried") == {"parent", "child", "old"}
    arrive(row("parent", 3, 11, 41))
    assert held("carried") == held("shots") == {"parent", "child"} and held("forks") == {"child"}
    arrive(row("parent", 4, 28, 42))
    assert held("carried") == {"parent"} and held("forks") == set() and got["parent", 4] == 1
    assert len(list((tmp_path / "state" / "carried").iterdir())) <= 3
