"""Scans over many blocks of one file equal those of one task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from token_ledger.operators import counters as C
from token_ledger.operators.segments import Carry, carry_along
from token_ledger.session import configure
from token_ledger.sources.line_agents import scan_codex

FIELDS = "struct<input:bigint,cached:bigint,output:bigint,reasoning:bigint,total:bigint>"
SCHEMA = f"file_path string, line bigint, total {FIELDS}, last {FIELDS}, model string, is_usage boolean, event_date string"


def _rows(seed, lines):
    rng, out, so_far = random.Random(seed), [], 0
    for file in ("one", "two"):
        for line in sorted(rng.sample(range(3 * lines), lines)):
            so_far = rng.choice([so_far, so_far + rng.randint(1, 9), rng.randint(0, 5)])
            count = lambda n: (n, 0, n // 2, 0, n)
            usage = rng.random() < 0.6
            model = rng.choice([None, None, None, "", "m1", "m2", C.REVIEW_MODEL])
            date = rng.choice([None, "2026-01-15T1", "2026-03-01T1"]) if usage else None
            out.append((file, line, count(so_far) if usage and rng.random() < 0.7 else None, count(3) if usage and rng.random() < 0.2 else None, model, usage, date))
    return out


def _by_hand(rows):
    """Last totals, usages, models and flags, one file after the other in plain steps."""
    out = {}
    for file in ("one", "two"):
        own = sorted((r for r in rows if r[0] == file), key=lambda r: r[1])
        previous, parts = None, [[]]
        for r in own:
            usage = r[3] or (tuple(max(0, a - b) for a, b in zip(r[2], previous or (0,) * 5, strict=True)) if r[2] else None)
            out[file, r[1]] = [previous, usage, r[2] is None or r[2] != previous]
            previous = r[2] or previous
            if r[4]:
                parts.append([])
            parts[-1].append(r)
        for n, part in enumerate(parts):
            stated = part[0][4] if n else None
            date = next((r[6] for r in part if r[5] and r[6]), None)
            review = C.REVIEW_TARGET if (date or "")[:10] >= C.REVIEW_SINCE else C.FALLBACK_MODEL
            model = C.FALLBACK_MODEL if n == 0 else review if stated == C.REVIEW_MODEL else stated
            first = next((r[1] for r in part if r[5]), None)
            for r in part:
                out[file, r[1]] += [model, n == 0 or (stated == C.REVIEW_MODEL and r[5] and r[1] == first)]
    return out


@pytest.mark.parametrize("block", [None, 1, 4, 50])
def test_counters_over_blocks(spark, block):
    rows = _rows(3, 150)
    want, df = _by_hand(rows), configure(spark).createDataFrame(rows, SCHEMA).repartition(3)
    usage = {(r["file_path"], r["line"]): r["usage"] and tuple(r["usage"]) for r in C.counter_delta(df, block=block).collect()}
    assert usage == {k: v[1] for k, v in want.items()}
    kept = {(r["file_path"], r["line"]) for r in C.drop_repeated_snapshot(df, block=block).collect()}
    assert kept == {k for k, v in want.items() if v[2]}
    told = C.resolve_fallback_model(df, block=block)
    assert {(r["file_path"], r["line"]): [r["resolved_model"], r["is_fallback"]] for r in told.collect()} == {k: v[3:] for k, v in want.items()}
    assert told.columns == [*df.columns, "resolved_model", "is_fallback"]
    filled = C.carry_forward(df, ["model", "total"], block=block)
    last = {}
    for r in sorted(filled.collect(), key=lambda r: (r["file_path"], r["line"])):
        own = next(x for x in rows if x[:2] == (r["file_path"], r["line"]))
        last[r["file_path"]] = own[4] if own[4] is not None else last.get(r["file_path"])
        assert r["model"] == last[r["file_path"]]


def test_one_file_goes_over_many_tasks(spark):
    spark = configure(spark)
    df = spark.range(20_000).select(F.lit("one").alias("file_path"), F.col("id").alias("line"), F.when(F.expr("id % 997 = 5"), F.col("id")).alias("seen"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = carry_along(df, {"last": Carry(F.col("seen")), "next": Carry(F.col("seen"), own=True, back=True)}, block=500).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r["task"] for r in out}) > 1
    for r in out:
        before = (r["line"] - 6) // 997 * 997 + 5
        after = -(-(r["line"] - 5) // 997) * 997 + 5
        assert r["last"] == (before if before >= 5 and r["line"] > 5 else None) and r["next"] == (after if after < 20_000 else None)


def test_codex_scan_over_blocks(spark, tmp_path):
    import json

    rng, so_far, made = random.Random(1), 0, []
    for n in range(300):
        so_far += rng.choice([0, 0, 7])
        usage = {"input_tokens": so_far, "cached_input_tokens": 0, "output_tokens": so_far // 2, "reasoning_output_tokens": 0, "total_tokens": so_far + so_far // 2}
        made.append({"timestamp": f"2026-03-01T00:{n // 60:02d}:{n % 60:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage}}})
        if n % 41 == 3:
            made.append({"type": "turn_context", "payload": {"model": rng.choice(["m1", "codex-auto-review"])}})
    place = tmp_path / "sessions" / "rollout-33333333-3333-3333-3333-333333333333.jsonl"
    place.parent.mkdir()
    place.write_text("".join(json.dumps(r) + "\n" for r in made))
    one, many = (sorted(map(str, scan_codex(configure(spark), str(tmp_path), block=b).drop("created_at").collect())) for b in (None, 20))
    assert one == many and len(one) > 50
