"""The source that follows growing files."""

from __future__ import annotations

import io
import os
import random

import pytest

from token_ledger.plans import store
from token_ledger.schema import TOKENS
from token_ledger.session import configure
from token_ledger.sources import lines, tail
from token_ledger.streaming import streams


def test_chunks_hold_every_line_once():
    rng = random.Random(7)
    for _ in range(300):
        text = b"".join(bytes(rng.choice(b"ab\r") for _ in range(rng.choice([0, 1, 3, 20]))) + b"\n" for _ in range(rng.randint(0, 12)))
        tailless = text + b"x" * rng.randint(0, 3)
        chunk, block = rng.randint(1, 9), rng.randint(1, 7)
        assert tail.last_line_end(io.BytesIO(tailless), 0, len(tailless), block) == len(text)
        got = []
        for at in range(0, len(text), chunk):
            got += tail.range_lines(io.BytesIO(tailless), at, min(at + chunk, len(text)), at == 0, len(text), block)
        assert [line for line, _ in got] == text.split(b"\n")[:-1]
        assert not got or got[-1][1] == len(text)


def _events(batch):
    """Lines ``key,tokens,day`` as events."""
    parts = batch.selectExpr("split(value, ',') AS v", "file_path", "line")
    return parts.selectExpr("'a' AS source_id", "v[0] AS dedup_key", "false AS is_sidechain_replay", "CAST(concat('2026-03-', v[2], ' 05:00:00') AS TIMESTAMP) AS timestamp_utc", "'fam' AS model_family", f"CAST(v[1] AS BIGINT) AS {TOKENS[0]}", *(f"CAST(0 AS BIGINT) AS {t}" for t in TOKENS[1:]), "CAST(0 AS DECIMAL(30,12)) AS cost_usd", "false AS cost_is_estimated", "file_path AS source_file_path", "line + 1 AS source_file_line", "line AS arrival")


@pytest.mark.parametrize("chunk", [None, 16])
def test_growing_files_equal_a_full_scan(spark, tmp_path, chunk):
    spark = configure(spark)
    logs, root, check = tmp_path / "logs", f"file://{tmp_path}/store", f"file://{tmp_path}/check"
    (logs / "deep").mkdir(parents=True)
    batches = []

    def sink(new, state, reset):
        batches.append({(r["file_path"].rsplit("/", 1)[1], r["line"]) for r in new.collect()})
        store.write_events(_events(new), root, state, removed=reset)

    def follow():
        streams.stream_tail(spark, str(logs), sink, check, lambda: store.read_state(spark, root), chunk_bytes=chunk, available_now=True).awaitTermination()

    def same():
        full = {(r["file_path"], r["line"] + 1, r["value"]) for r in lines.read_lines(spark, str(logs)).collect()}
        held = {(r["source_file_path"], r["source_file_line"], f"{r['dedup_key']},{r['input_tokens']},{r['timestamp_utc'].day:02d}") for r in store.read_events(spark, root).collect()}
        assert held == full

    def add(name, text):
        with open(logs / name, "a", newline="") as f:
            f.write(text)

    add("a.jsonl", "k1,1,01\nk2,2,02\nk3,3")  # cut inside a line
    add("other.txt", "k9,9,09\n")
    follow()
    assert batches[-1] == {("a.jsonl", 0), ("a.jsonl", 1)}
    add("a.jsonl", ",03\n\nk4,4,04\n")
    add("deep/b.jsonl", "b1,1,01\n")
    follow()
    same()
    assert batches[-1] == {("a.jsonl", 2), ("a.jsonl", 4), ("b.jsonl", 0)}
    follow()
    assert len(batches) == 2  # nothing new, no batch
    add("a.jsonl", "k5,5,05\n")
    os.truncate(logs / "deep/b.jsonl", 0)
    follow()
    same()
    add("deep/b.jsonl", "b2,7,02\n")  # shorter or as long as before, but another file
    follow()
    same()
    (logs / "a.jsonl").write_text("n1,1,01\n")
    follow()
    same()
    state = {r["file_path"].rsplit("/", 1)[1]: (r["byte_offset"], r["line_index"]) for r in store.read_state(spark, root).collect()}
    assert state == {"a.jsonl": (8, 1), "b.jsonl": (8, 1)}


def test_batch_that_runs_again_adds_nothing(spark, tmp_path):
    spark = configure(spark)
    path = tmp_path / "a.jsonl"
    path.write_text("k1,1,01\nk2,2,02\n")
    reader = tail.TailReader({"path": str(tmp_path), "log": str(tmp_path / "plans"), "glob": "*.jsonl", "chunkbytes": "8"})
    first = reader.latestOffset()
    path.write_text(path.read_text() + "k3,3,03\n")
    again = tail.TailReader({"path": str(tmp_path), "log": str(tmp_path / "plans"), "glob": "*.jsonl", "chunkbytes": "8"})  # a restart
    second = again.latestOffset()
    assert (first, second) == ({"plan": 1}, {"plan": 2})

    def batch(start, end):
        rows = [r for part in again.partitions(start, end) for b in again.read(part) for r in b.to_pylist()]
        return spark.createDataFrame([tuple(r.values()) for r in rows], tail.SCHEMA)

    lines_, state, reset = streams.number_lines(batch({"plan": 0}, first), None)
    assert [tuple(r)[1:3] for r in lines_.orderBy("line").collect()] == [(0, "k1,1,01"), (1, "k2,2,02")] and reset.isEmpty()
    assert streams.number_lines(batch({"plan": 0}, first), state)[0].isEmpty()  # the sink had committed before the crash
    both, after, _ = streams.number_lines(batch({"plan": 0}, second), state)
    assert [(r["line"], r["value"]) for r in both.collect()] == [(2, "k3,3,03")] and after.first()["line_index"] == 3


def test_late_rows_reach_their_hours_and_day(spark, tmp_path):
    spark = configure(spark)
    landed, root, out = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    schema = "value string, file_path string, line long"

    def arrive(*values):
        spark.createDataFrame([(v, "f", n) for n, v in enumerate(values)], schema).coalesce(1).write.mode("append").parquet(f"file://{landed}")
        stream = spark.readStream.schema(schema).parquet(f"file://{landed}")
        streams.stream_to_store(stream, root, f"file://{tmp_path}/check", scan=_events, available_now=True).awaitTermination()

    arrive("k1,1,01", "k2,2,04")
    store.publish_store(spark, root, out, "dev", "now")
    assert store.dirty_days(spark, root, out).isEmpty()
    arrive("k3,5,01")  # three days behind what has been seen
    assert [(str(r["day_utc"]), r["revision"]) for r in store.dirty_days(spark, root, out).collect()] == [("2026-03-01", 2)]
    assert {(r["hour_utc"].day, r["input_tokens"], r["event_count"]) for r in store.read_hours(spark, root).collect()} == {(1, 6, 2), (4, 2, 1)}
