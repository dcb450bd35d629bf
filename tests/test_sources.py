"""Scans of literal logs on disk, and the parts that read and list files."""

from __future__ import annotations

import json

import pytest

from token_ledger.operators import counters, dedup, incremental
from token_ledger.sources import lines, registry
from token_ledger.sources.published import read_price_snapshot

TOKENS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "reasoning_tokens")


def _write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def _tokens(df):
    return sorted(tuple(r[t] for t in TOKENS) for r in df.collect())


def _count(total, last=None, at="2026-01-02T00:00:00Z"):
    usage = lambda n: {"input_tokens": n, "cached_input_tokens": n // 4, "output_tokens": n // 2, "reasoning_output_tokens": 1, "total_tokens": n + n // 2}
    info = {k: usage(v) for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v is not None}
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def test_claude_literal(spark, tmp_path):
    usage = {"input_tokens": 731, "output_tokens": 64, "cache_creation_input_tokens": 8, "cache_read_input_tokens": 18, "cache_creation": {"ephemeral_5m_input_tokens": 31, "ephemeral_1h_input_tokens": 6}}
    good = {"timestamp": "2026-05-01T10:00:00.000Z", "sessionId": "talk-a", "version": "7.0.2", "costUSD": 0.37, "message": {"id": "msg-a", "model": "claude-opus-4-20250601", "usage": usage}}
    bad = [{**good, "version": "x"}, {**good, "sessionId": ""}, {**good, "message": {**good["message"], "model": "<synthetic>"}}, "not json \"usage\"", ""]
    _write(tmp_path / "projects" / "garden" / "talk-a.jsonl", good, *bad)
    row = registry.scan(spark, "claude-code", str(tmp_path)).collect()
    assert len(row) == 1 and tuple(row[0][t] for t in TOKENS) == (731, 64, 37, 18, 0)
    assert (row[0]["dedup_key"], row[0]["project_or_workspace"], float(row[0]["reported_cost"])) == ("claude-message:msg-a", "garden", 0.37)


def test_codex_counters_and_fork(spark, tmp_path):
    parent, child = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    root = tmp_path / "sessions" / "2026"
    context = {"type": "turn_context", "payload": {"model": "gpt-5.1-codex"}}
    _write(root / f"rollout-{parent}.jsonl", {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": parent}}, context, _count(100), _count(100), _count(300), _count(None, 40))
    _write(root / f"rollout-{child}.jsonl", {"timestamp": "2026-01-03T00:00:00Z", "type": "session_meta", "payload": {"id": child, "forked_from_id": parent}}, context, _count(100), _count(100), _count(300), _count(None, 40), _count(700))
    got = registry.scan(spark, "codex-cli", str(tmp_path))
    assert _tokens(got.filter("session_id LIKE '%1111%'")) == [(30, 20, 0, 10, 1), (75, 50, 0, 25, 1), (150, 100, 0, 50, 0)]
    assert _tokens(got.filter("session_id LIKE '%2222%'")) == [(300, 200, 0, 100, 0)]
    assert {r["model_raw"] for r in got.collect()} == {"gpt-5.1-codex"}


def test_line_numbers_hold_over_splits(spark, tmp_path):
    _write(tmp_path / "a.jsonl", *[f"line {k}" if k % 7 else "" for k in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == sum(bool(k % 7) for k in range(5000)) and all(r["value"] == f"line {r['line']}" for r in rows)


def test_live_files_win(spark, tmp_path):
    for folder in ("sessions", "archived_sessions"):
        _write(tmp_path / folder / "x.jsonl", "{}")
    _write(tmp_path / "archived_sessions" / "y.jsonl", "{}")
    kept = lines.prefer_live_over_archived(lines.discover_files(spark, str(tmp_path), "*.jsonl"))
    assert sorted(r["file_path"].removeprefix(str(tmp_path)) for r in kept.collect()) == ["/archived_sessions/y.jsonl", "/sessions/x.jsonl"]


def test_price_snapshot_override(spark, tmp_path):
    _write(tmp_path / "a.json", {"m": {"inputPerMillion": 3.75, "outputPerMillion": 15}, "n": {"inputPerMillion": 1, "outputPerMillion": 2, "cacheReadPerMillion": 0.1}})
    _write(tmp_path / "b.json", {"m": {"inputPerMillion": 4, "outputPerMillion": 16}})
    got = {r["family"]: str(r["input_rate"]) for r in read_price_snapshot(spark, f"{tmp_path}/a.json", f"{tmp_path}/b.json").collect()}
    assert got == {"m": "0.000004000000", "n": "0.000001000000"}


def test_plan_and_paths(spark):
    files = spark.createDataFrame([("/a/b.db",), ("/a/c/d.jsonl",), ("/e/f.jsonl",)], "file_path string")
    at = lambda *p: sorted(r["file_path"] for r in incremental.changed_path_filter(files, spark.createDataFrame([(x,) for x in p], "path string")).collect())
    assert at("/a/b.db-wal") == ["/a/b.db"] and at("/a") == ["/a/b.db", "/a/c/d.jsonl"] and at("/a/c/d.jsonl/x") == ["/a/c/d.jsonl"] and len(at()) == 3


def test_dedup_does_not_depend_on_row_order(spark):
    rows = [("s", f"k{n % 40}", n % 3 == 0, n * 7 % 11, n) for n in range(400)]
    shape = "source_id string, dedup_key string, is_sidechain_replay boolean, input_tokens long, arrival long"
    frame = lambda data: spark.createDataFrame(data, shape).selectExpr("*", *(f"0L AS {t}" for t in TOKENS[1:]))
    pick = lambda df: sorted(r["arrival"] for r in dedup.dedup_events(df).collect())
    assert pick(frame(rows)) == pick(frame(rows[::-1]).repartition(7)) and len(pick(frame(rows))) == 40


@pytest.mark.parametrize("date,model", [("2026-01-31", "gpt-5"), ("2026-02-01", "gpt-5.1-codex")])
def test_review_model(spark, date, model):
    rows = [("f", 1, None, True, date), ("f", 2, "codex-auto-review", False, None), ("f", 3, None, True, date), ("f", 4, None, True, date)]
    got = counters.resolve_fallback_model(spark.createDataFrame(rows, "file_path string, line long, model string, is_usage boolean, event_date string")).filter("is_usage").orderBy("line").collect()
    assert [(r["resolved_model"], r["is_fallback"]) for r in got] == [("gpt-5", True), (model, True), (model, False)]
