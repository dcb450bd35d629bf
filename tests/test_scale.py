"""What a step does as its input grows: plans, tasks and files, not rows alone."""

import datetime as dt

from pyspark.sql import functions as F

from token_ledger.operators import dedup as D
from token_ledger.operators import lookups as L
from token_ledger.schema import TOKENS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_and_sidecars_are_not_broadcast(spark):
    """Both sides grow with the logs, however small Spark takes them for."""
    n = spark.range(10).select(F.lit("f").alias("file_path"), F.col("id").alias("message_id"), F.col("id").alias("position"), F.col("id").alias("cache_create"), F.col("id").alias("cache_read"))
    joined = L.ledger_cache_join(n.select("file_path", "message_id"), n)
    assert "Broadcast" not in _plan(joined) and "SortMergeJoin" in _plan(joined)
    assert joined.count() == 10
    side = spark.createDataFrame([("a", 1, "m")], "side string, line int, model string")
    beside = L.sidecar_join(spark.createDataFrame([("a",), ("b",)], "side string"), side, "side", "model")
    assert "Broadcast" not in _plan(beside)
    assert sorted(tuple(r) for r in beside.collect()) == [("a", "m"), ("b", None)]


def _scans(df) -> int:
    return _plan(df).count("FileScan text")


def test_filtered_lines_of_cut_files(spark, tmp_path):
    """A filter on the path must not part the files of one scan otherwise than those of the other."""
    from token_ledger.sources.lines import read_lines

    for n in range(5):
        (tmp_path / f"{n}.jsonl").write_text("".join(f"{n},{i}\n" for i in range(2_000 * (n + 1))))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for whole in (0, 30_000, 1 << 20):
            rows = read_lines(spark, str(tmp_path), whole_bytes=whole).filter("file_path LIKE '%/4.jsonl'").collect()
            assert sorted((r["line"], r["value"]) for r in rows) == [(i, f"4,{i}") for i in range(10_000)]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_small_files_are_not_shuffled(spark, tmp_path):
    """Lines of small files are numbered where they are read, with the same ends and marks as the text source knows."""
    from token_ledger.sources.lines import read_lines

    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbfone\r\n\r\ntwo\rthree\n  \nfour\n\n")
    (tmp_path / "b.jsonl").write_bytes(b"")
    (tmp_path / "c.jsonl").write_bytes(b"\n\nlast")
    want = [("a", 0, "one"), ("a", 2, "two"), ("a", 3, "three"), ("a", 5, "four"), ("c", 2, "last")]
    for whole in (0, 4 << 20):
        rows = read_lines(spark, str(tmp_path), whole_bytes=whole)
        assert sorted((r["file_path"][-7], r["line"], r["value"]) for r in rows.collect()) == want
    small = _plan(read_lines(spark, str(tmp_path))).split("Union")[1]
    assert small.index("FileScan text") < (small.index("Exchange") if "Exchange" in small else len(small))


def test_small_growing_files_share_tasks(tmp_path):
    """A task for each file would be as many tasks as files; lines are those of all files for all that."""
    from token_ledger.sources import tail

    logs = tmp_path / "logs"
    logs.mkdir()
    for n in range(2_000):
        (logs / f"{n:04d}.jsonl").write_text("".join(f"{n},{i}\n" for i in range(n % 7)))
    reader = tail.TailReader({"path": str(logs), "log": str(tmp_path / "plans"), "chunkbytes": 5})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) < 50
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["value"] for r in rows) == sorted(f"{n},{i}" for n in range(2_000) for i in range(n % 7))
    whole = tail.bundles([tail.Range("", "a", 0, tail.CHUNK_BYTES, True, 9, 0.0, False)] * 3, tail.CHUNK_BYTES)
    assert [len(b.ranges) for b in whole] == [1, 1, 1]


class _State:
    """What the state function uses of a group's state."""

    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True


def test_files_of_a_group_are_worked_on_together():
    """Many files in one call, in three parts, give what each gives alone."""
    import random

    import pandas as pd

    from token_ledger.operators.counters import COUNTER_FIELDS
    from token_ledger.streaming.streams import _delta

    rng, rows = random.Random(5), []
    for n in range(40):
        at = 0
        for line in range(rng.randint(1, 9)):
            at += rng.choice([0, 5, 70])
            use, total, last = rng.random() < 0.8, rng.random() < 0.7, rng.random() < 0.3
            counts = {f"total_{f}": at if use and total else None for f in COUNTER_FIELDS} | {f"last_{f}": 3 if use and last else None for f in COUNTER_FIELDS}
            rows.append({"file_path": f"f{n}", "line": line, **counts, "model": rng.choice([None, "", "m", "codex-auto-review"]), "is_usage": use, "event_date": rng.choice([None, "2026-01-05", "2026-03-01"])})
    df = pd.DataFrame(rows)

    def run(parts):
        state, out = _State(), []
        for part in parts:
            if len(part):
                out += [tuple(r) for o in _delta((0,), iter([part]), state) for r in o.itertuples(index=False)]
        return out, state.get

    cuts = lambda d: [d[d["line"] < 2], d[d["line"].between(2, 4)], d[d["line"] > 4]]
    together, held = run(cuts(df.sample(frac=1, random_state=1)))
    alone = [run(cuts(d)) for _, d in df.groupby("file_path")]
    assert len(together) > 50 and sorted(together) == sorted(r for out, _ in alone for r in out)
    assert sorted(zip(*held, strict=True), key=repr) == sorted((tuple(c[0] for c in state) for _, state in alone), key=repr)


def test_listing_takes_few_tasks(spark, tmp_path):
    """A batch of many small files is listed by a bounded number of tasks, not by one for each few paths."""
    from token_ledger.session import configure

    paths = []
    for n in range(300):
        (tmp_path / f"{n}.txt").write_text("x\n")
        paths.append(str(tmp_path / f"{n}.txt"))
    context = configure(spark).sparkContext
    context.setJobGroup("listing", "listing")
    spark.read.text(paths)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 100


def test_store_scans_its_rows_once(spark, monkeypatch):
    """What several writes and the state read is priced once, not by each of them."""
    import pytest

    from token_ledger import queries as core
    from token_ledger.plans import store

    class Seen(Exception):
        pass

    def write(incoming, root, state):
        raise Seen([*incoming.inputFiles(), *state.inputFiles()])

    monkeypatch.setattr(store, "write_events", write)
    with pytest.raises(Seen) as seen:
        core.queries()["event_store"](spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] and not any("events.parquet" in f for f in seen.value.args[0])


def _keyed(spark, rows):
    return spark.createDataFrame([(s, k, False, n, 0, 0, 0, 0, i, dt.datetime(2024, 1, i + 1)) for s, k, n, i in rows], f"source_id string, dedup_key string, is_sidechain_replay boolean, {', '.join(f'{t} bigint' for t in TOKENS)}, arrival bigint, timestamp_utc timestamp")


def test_rows_are_merged_in_one_move(spark):
    """A merge moves rows once, to their keys; days are told from what has come and gone."""
    old = _keyed(spark, [("a", "k", 5, 0), ("a", "l", 5, 1), ("a", None, 1, 2), ("a", "m", 5, 3)])
    new = _keyed(spark, [("a", "k", 9, 4), ("a", "l", 5, 5), ("a", None, 7, 6), ("a", "n", 1, 7)])
    merged = D.upsert_events(old, new)
    assert _plan(merged).count("Exchange hashpartitioning") == 1
    assert sorted(r["arrival"] for r in merged.collect()) == [1, 2, 3, 4, 6, 7]
    days = D.changed_days(D.upsert_sides(old, new))
    assert sorted((r["day_utc"].day, r["changes"]) for r in days.collect()) == [(1, 1), (5, 1), (7, 1), (8, 1)]
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, D.touched_days(old, merged).collect()))


def test_values_are_carried_over_blocks_without_a_join(spark):
    """What comes from other blocks of a file stands at their ends; a row finds it without a join of all rows."""
    from token_ledger.operators.segments import Carry, carry_along

    rows = spark.createDataFrame([("f", i, i if i in (3, 17) else None) for i in range(30)], "file_path string, line bigint, v bigint")
    out = carry_along(rows, {"last": Carry(F.col("v")), "next": Carry(F.col("v"), own=True, back=True)}, block=5)
    assert "Join" not in _plan(out)
    want = [(i, 17 if i > 17 else 3 if i > 3 else None, 3 if i <= 3 else 17 if i <= 17 else None) for i in range(30)]
    assert sorted((r["line"], r["last"], r["next"]) for r in out.collect()) == want


def test_many_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """Beyond a few, files are rows: none is listed in the driver, each is read where its row is, and lines are those of Spark's reader."""
    import gzip

    from token_ledger.sources.lines import read_lines

    for n in range(150):
        (tmp_path / f"s={n % 70}" / "deep er").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"s={n % 70}" / "deep er" / f"{n}+%41.jsonl").write_bytes(f"{n},0\r\n\n \n{n},3\rnot\n\n".encode() * (1 + 300 * (n == 7)) + b"last" * (n % 2))
    for name in ("_hidden.jsonl", ".x.jsonl", "other.txt", "_temporary/a.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"no\n")
    (tmp_path / "mark.jsonl").write_bytes(b"\xef\xbb\xbf\xc3\xa4\n")
    (tmp_path / "broken.jsonl").write_bytes(b"\xff\xfe\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "x[1].jsonl.gz").write_bytes(gzip.compress(b"packed\nlines\n"))
    for glob in ("*.jsonl", "*"):
        for whole in (1_000, 4 << 20):
            few, many = (read_lines(spark, str(tmp_path), glob, whole, limit) for limit in (1_000, 0))
            want, got = (sorted(map(tuple, df.selectExpr("file_path", "line", "hex(value) AS value", "modified_at").collect())) for df in (few, many))
            assert got == want and len(got) > 150 * 4
    plan = _plan(read_lines(spark, str(tmp_path), few=0))
    assert "FileScan text" not in plan and "MapInArrow" in plan


def test_planning_opens_no_file_and_holds_none(tmp_path, monkeypatch):
    """A plan takes a listing only; what it leaves in the driver is 24 bytes a file and a few names of parts."""
    import pickle

    from token_ledger.sources import tail

    logs = tmp_path / "logs"
    logs.mkdir()
    for n in range(3_000):
        (logs / f"{n:04d}.jsonl").write_text(f"{n},0\n{n}")
    opened = tail.opened
    monkeypatch.setattr(tail, "opened", None)
    reader = tail.TailReader({"path": str(logs), "log": str(tmp_path / "plans")})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    held = reader.planner.offsets
    assert held.keys.nbytes + held.ends.nbytes == 24 * 3_000 and len(pickle.dumps(parts)) < 5_000
    monkeypatch.setattr(tail, "opened", opened)
    lines = lambda parts: sorted(r["value"] for p in parts for b in reader.read(p) for r in b.to_pylist() if r["value"])
    assert lines(parts) == sorted(f"{n},0" for n in range(3_000))
    for n in range(0, 3_000, 2):
        (logs / f"{n:04d}.jsonl").write_text(f"{n},0\n{n},1\n{n}")
    again = tail.TailReader({"path": str(logs), "log": str(tmp_path / "plans")})
    assert lines(again.partitions({"plan": 1}, again.latestOffset())) == sorted(f"{n},1" for n in range(0, 3_000, 2))
    assert again.latestOffset() == {"plan": 2}


def test_plans_are_snapshot_and_files_reset_between_plans(tmp_path):
    from token_ledger.sources import tail

    logs, options = tmp_path / "logs", {"log": str(tmp_path / "plans"), "chunkbytes": 4}
    logs.mkdir()
    options["path"] = str(logs)
    for n in range(1, 20):
        (logs / "a").write_text("".join(f"a{i}\n" for i in range(n)))
        (logs / "b").write_text("".join(f"b{n}.{i}\n" for i in range(1 + n % 3)))
        assert tail.TailReader(options).latestOffset() == {"plan": n}
    assert len(list((tmp_path / "plans").glob("offsets-*"))) == 1
    reader = tail.TailReader(options)
    rows = [r for p in reader.partitions({"plan": 10}, {"plan": 19}) for b in reader.read(p) for r in b.to_pylist() if r["value"]]
    assert [r["value"] for r in rows if r["file_path"].endswith("a")] == [f"a{i}" for i in range(10, 19)]
    assert sorted({r["value"] for r in rows if r["file_path"].endswith("b")}) == ["b19.0", "b19.1"] and len(rows) == 11
    assert all(r["reset"] for r in rows if r["file_path"].endswith("b"))


def test_another_file_by_a_name_is_read_anew(spark, tmp_path):
    """A file that has grown but doesn't go on where its lines ended is reset, without a look at it in the driver."""
    from token_ledger.session import configure
    from token_ledger.streaming.streams import stream_tail

    logs, kept, seen = tmp_path / "logs", [], []
    logs.mkdir()

    def sink(lines, state, reset):
        seen.append((sorted((r["file_path"][-7], r["line"], r["value"]) for r in lines.collect()), sorted(r["file_path"][-7] for r in reset.collect())))
        rows = {r["file_path"]: r for r in (kept[-1].collect() if kept else [])} | {r["file_path"]: r for r in state.collect()}
        kept.append(spark.createDataFrame(list(rows.values()), state.schema))

    def follow():
        stream_tail(configure(spark), str(logs), sink, f"file://{tmp_path}/check", lambda: kept[-1] if kept else None, available_now=True, chunk_bytes=8).awaitTermination()

    (logs / "a.jsonl").write_text("one\ntwo\nthr")
    (logs / "b.jsonl").write_text("one\ntwo\nthr")
    (logs / "c.jsonl").write_text("thr")
    follow()
    assert seen[-1] == ([(f, n, v) for f in "ab" for n, v in enumerate(("one", "two"))], [])
    (logs / "a.jsonl").write_text("one\ntwo\nthree\nfour\n")
    (logs / "b.jsonl").write_text("another one\nline here\nand more\ncut")
    (logs / "c.jsonl").write_text("three\n")
    follow()
    assert seen[-1] == ([("a", 2, "three"), ("a", 3, "four"), ("b", 0, "another one"), ("b", 1, "line here"), ("b", 2, "and more"), ("c", 0, "three")], ["b"])
    (logs / "b.jsonl").write_text("another one\nline here\nand more\ncut off\n")
    follow()
    assert seen[-1] == ([("b", 3, "cut off")], [])


def test_rolled_files_are_ingested_without_a_shuffle_of_lines(spark, tmp_path, monkeypatch):
    """Rolled files are taken once, whole, with the lines that Spark's own stream of files gives."""
    import gzip

    from token_ledger.session import configure
    from token_ledger.sources import listing
    from token_ledger.streaming.streams import stream_ingest

    logs, plans = tmp_path / "logs", []
    (logs / "deep").mkdir(parents=True)

    def follow(check):
        got = []

        def sink(batch):
            plans.append(_plan(batch))
            got.extend(sorted((r["file_path"].rsplit("/", 1)[1], r["line"], r["value"], r["modified_at"]) for r in batch.collect()))

        stream_ingest(configure(spark), str(logs), lambda rows: rows, sink, f"file://{tmp_path}/{check}", available_now=True).awaitTermination()
        return got

    def both():
        new = follow("rolled")
        with monkeypatch.context() as m:
            m.setattr(listing, "known_place", lambda *_: None)
            return new, follow("text")

    for n in range(30):
        (logs / "deep" / f"{n} +%.txt").write_bytes(f"{n},0\r\n\n \n{n},3".encode() + b"\n" * (n % 3))
    (logs / "p.log.gz").write_bytes(gzip.compress(b"packed\n\nlines"))
    (logs / "_hidden").write_bytes(b"no\n")
    (logs / "none").write_bytes(b"")
    new, old = both()
    assert new == old and len(new) > 120
    (logs / "late").write_bytes(b"late\n")
    (logs / "deep" / "0 +%.txt").write_bytes(b"0,0\nrolled files are taken once\n")
    new, old = both()
    assert [r[:3] for r in new] == [r[:3] for r in old] == [("late", 0, "late")]
    assert "Window" not in plans[-2] and "Sort" not in plans[-2]
    assert follow("rolled") == []


def test_a_file_that_shrank_to_nothing_is_told_though_gone(tmp_path):
    from token_ledger.sources import tail

    logs, options = tmp_path / "logs", {"path": str(tmp_path / "logs"), "log": str(tmp_path / "plans")}
    logs.mkdir()
    (logs / "a").write_text("one\n")
    tail.TailReader(options).latestOffset()
    (logs / "a").write_text("")
    reader = tail.TailReader(options)
    parts = reader.partitions({"plan": 1}, reader.latestOffset())
    (logs / "a").unlink()
    assert [(r["row"], r["end"], r["reset"]) for p in parts for b in reader.read(p) for r in b.to_pylist()] == [(None, 0, True)]
