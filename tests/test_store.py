"""The versioned store: writers that meet, files that shrink, day revisions, maintained hours, expiry."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from token_ledger.operators.rollup import hourly_rollup
from token_ledger.plans import storage, store
from token_ledger.schema import TOKENS
from token_ledger.session import configure

SCHEMA = f"source_id string, dedup_key string, is_sidechain_replay boolean, timestamp_utc timestamp, model_family string, {', '.join(f'{t} bigint' for t in TOKENS)}, cost_usd decimal(30,12), cost_is_estimated boolean, source_file_path string, arrival bigint"


def _events(spark, *rows):
    """Rows of (source, key, day of March, tokens, file)."""
    made = [(s, k, False, dt.datetime(2026, 3, day, 5 + n % 3), "fam", n, 1, 0, 0, 0, None, False, f, 1) for s, k, day, n, f in rows]
    return configure(spark).createDataFrame(made, SCHEMA)


def _state(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, byte_offset bigint")


def _held(spark, root):
    rows = store.read_events(spark, root).collect()
    assert len({(r["source_id"], r["dedup_key"]) for r in rows}) == len(rows)
    return {(r["source_id"], r["dedup_key"], r["day_utc"].day, r["input_tokens"], r["source_file_path"]) for r in rows}


def _revisions(df):
    return {r["day_utc"].day: r["revision"] for r in df.collect()}


def _hours_are_right(spark, root):
    shape = ["hour_utc", "source_id", "model_family", *TOKENS, "cost_usd", "event_count", "estimated_event_count"]
    want, got = hourly_rollup(store.read_events(spark, root)).select(shape), store.read_hours(spark, root).select(shape)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture
def between(monkeypatch):
    """Runs something else between a writer's merge and its commit, once."""

    def put(other):
        write, merges = store._write_version, []

        def meddled(merged, root, version):
            write(merged, root, version)
            merges.append(version)
            if len(merges) == 1:
                other()

        monkeypatch.setattr(store, "_write_version", meddled)
        return merges

    return put


def test_second_writer_keeps_what_the_first_brought(spark, tmp_path, between):
    root = f"file://{tmp_path}/s"
    store.write_events(_events(spark, ("a", "k0", 1, 10, "f0")), root, _state(spark, ("f0", 1)))
    merges = between(lambda: store.write_events(_events(spark, ("b", "k1", 2, 20, "f1")), root, _state(spark, ("f1", 2))))
    version = store.write_events(_events(spark, ("a", "k2", 3, 30, "f2")), root, _state(spark, ("f2", 3)))
    assert _held(spark, root) == {("a", "k0", 1, 10, "f0"), ("b", "k1", 2, 20, "f1"), ("a", "k2", 3, 30, "f2")}
    assert {r["file_path"] for r in store.read_state(spark, root).collect()} == {"f0", "f1", "f2"}
    assert store.pointers(spark, root) == [1, 2, 3] and merges[0] == version and len(merges) == 2  # other partitions: no second merge
    assert _revisions(store.read_days(spark, root)) == {1: 1, 2: 1, 3: 1}
    _hours_are_right(spark, root)


@pytest.mark.parametrize("day", [1, 9])
def test_writers_of_one_key_or_partition_merge_again(spark, tmp_path, between, day):
    root = f"file://{tmp_path}/s"
    store.write_events(_events(spark, ("a", "k0", 1, 10, "f0")), root)
    merges = between(lambda: store.write_events(_events(spark, ("a", "k1", day, 20, "f1"), ("a", "k3", 4, 1, "f1")), root))
    store.write_events(_events(spark, ("a", "k1", 1, 30, "f2"), ("a", "k2", 2, 5, "f2")), root)
    assert _held(spark, root) == {("a", "k0", 1, 10, "f0"), ("a", "k1", 1, 30, "f2"), ("a", "k2", 2, 5, "f2"), ("a", "k3", 4, 1, "f1")}
    assert len(merges) == 3 and merges[0] not in storage.names(spark, f"{root}/events")
    _hours_are_right(spark, root)


def test_first_commits_that_meet(spark, tmp_path, between):
    root = f"file://{tmp_path}/s"
    between(lambda: store.write_events(_events(spark, ("a", "k1", 1, 9, "f1")), root))
    store.write_events(_events(spark, ("a", "k2", 1, 5, "f2"), ("a", "k1", 1, 4, "f2")), root)
    assert _held(spark, root) == {("a", "k1", 1, 9, "f1"), ("a", "k2", 1, 5, "f2")}


def test_many_writers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    parts = [_events(spark, *((f"s{k % 2}", f"k{k}-{i}", 1 + (k + i) % 3, 10 * k + i, f"f{k}") for i in range(4))) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda p: store.write_events(p, root), parts))
    assert len(_held(spark, root)) == 16 and store.pointers(spark, root) == [1, 2, 3, 4]
    _hours_are_right(spark, root)


def test_pointers_are_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/p/1"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda n: storage.create_once(spark, path, str(n)), range(8)))
    assert sum(made) == 1 and storage.read_text(spark, path) == str(made.index(True))
    assert storage.names(spark, f"file://{tmp_path}/p") == ["1"]


def test_shrunken_file_goes_with_its_state(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store.write_events(_events(spark, ("a", "k1", 1, 1, "f1"), ("a", "k2", 2, 2, "f1"), ("a", "k3", 2, 3, "f2"), ("a", "k4", 5, 4, "f1")), root, _state(spark, ("f1", 100), ("f2", 50), ("f3", 7)))
    before = store.current(spark, root)
    store.write_events(_events(spark, ("a", "k9", 3, 9, "f1")), root, _state(spark, ("f1", 10)), removed=spark.createDataFrame([("f1",), ("f3",)], "file_path string"))
    assert _held(spark, root) == {("a", "k3", 2, 3, "f2"), ("a", "k9", 3, 9, "f1")}
    assert {tuple(r) for r in store.read_state(spark, root).collect()} == {("f1", 10), ("f2", 50)}
    assert _revisions(store.read_days(spark, root)) == {1: 2, 2: 2, 3: 1, 5: 2}
    assert store.read_events(spark, root, before.number).count() == 4  # the commit before is whole yet
    _hours_are_right(spark, root)
    store.write_events(_events(spark), root, removed=spark.createDataFrame([("f1",), ("f2",)], "file_path string"))
    assert _held(spark, root) == set() and store.read_hours(spark, root).count() == 0


def test_what_changes_no_row_changes_no_revision(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    rows = _events(spark, ("a", "k1", 1, 5, "f"), ("a", "k2", 2, 5, "f"))
    for _ in range(2):  # a batch that runs again
        store.write_events(rows, root)
    store.write_events(_events(spark, ("a", "k2", 2, 4, "f"), ("a", "k1", 3, 6, "f")), root)  # the first loses, the second moves its event
    assert _revisions(store.read_days(spark, root)) == {1: 2, 2: 1, 3: 1} and _held(spark, root) == {("a", "k1", 3, 6, "f"), ("a", "k2", 2, 5, "f")}


def test_removal_meets_a_writer_of_the_same_file(spark, tmp_path, between):
    root = f"file://{tmp_path}/s"
    store.write_events(_events(spark, ("a", "k1", 1, 1, "f1")), root)
    between(lambda: store.write_events(_events(spark, ("a", "k2", 8, 2, "f1")), root))
    store.write_events(_events(spark, ("a", "k3", 1, 3, "f1")), root, removed=spark.createDataFrame([("f1",)], "file_path string"))
    assert _held(spark, root) == {("a", "k3", 1, 3, "f1")}


def test_commit_reads_matched_partitions_only(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    store.write_events(_events(spark, *(("a", f"k{d}", d, d, "f") for d in range(1, 21))), root)
    read = []
    own = store._partitions
    monkeypatch.setattr(store, "_partitions", lambda *a: read.append((a[3], own(*a))) or read[-1][1])
    store.write_events(_events(spark, ("a", "k5", 7, 50, "f"), ("a", "new", 20, 1, "f")), root)
    plan = read[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and read[0][1].select("day_utc").distinct().count() == 3  # where k5 was, where it is now, where the new one is
    assert {name for name, _ in read} == {"events"} and {d for (d,) in read[0][1].selectExpr("day(day_utc)").distinct().collect()} == {5, 7, 20}
    assert ("a", "k5", 7, 50, "f") in _held(spark, root) and len(_held(spark, root)) == 21


def test_publication_is_of_a_revision(spark, tmp_path, monkeypatch):
    root, out = f"file://{tmp_path}/s", f"file://{tmp_path}/out"
    store.write_events(_events(spark, ("a", "k1", 1, 1, "f"), ("a", "k2", 2, 2, "f")), root)
    publish = store.publish_days

    def meddled(*args):
        store.write_events(_events(spark, ("a", "k3", 2, 3, "f"), ("a", "k4", 3, 4, "f")), root)
        return publish(*args)

    monkeypatch.setattr(store, "publish_days", meddled)
    store.publish_store(spark, root, out, "dev", "now")
    monkeypatch.setattr(store, "publish_days", publish)
    assert _revisions(store.dirty_days(spark, root, out)) == {2: 2, 3: 1}  # a write between read and publish leaves its day dirty
    changes = store.publish_store(spark, root, out, "dev", "later")
    assert {(r["day_utc"], r["change"]) for r in changes.collect()} == {("2026-03-02", "changed"), ("2026-03-03", "new")}
    assert store.dirty_days(spark, root, out).isEmpty() and spark.read.parquet(f"{out}/manifest").count() == 3
    # A publisher that comes late with an old snapshot leaves newer days alone.
    old = store.read_hours(spark, root, number=1).withColumn("device_id", F.lit("dev"))
    manifest = spark.read.parquet(f"{out}/manifest").select("device_id", F.col("day_utc").cast("string").alias("day_utc"), "checksum", "bucket_count")
    wanted = {tuple(r) for r in manifest.collect()}
    store.publish_days(old, out, manifest, "old", revisions=store.read_days(spark, root, 1), clean=manifest.filter("day_utc = '2026-03-03'"))
    assert {(r["device_id"], str(r["day_utc"]), r["checksum"], r["bucket_count"]) for r in spark.read.parquet(f"{out}/manifest").collect()} == wanted
    assert store.dirty_days(spark, root, out).isEmpty()
    store.write_events(_events(spark), root, removed=spark.createDataFrame([("f",)], "file_path string"))
    assert {r["change"] for r in store.publish_store(spark, root, out, "dev", "end").collect()} == {"gone"}
    assert not storage.names(spark, f"{out}/manifest") or spark.read.schema(store._MANIFEST).parquet(f"{out}/manifest").isEmpty()


def test_expiry_leaves_what_is_read(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    for n in range(4):
        store.write_events(_events(spark, ("a", "same", 1, n + 1, "f"), ("a", f"k{n}", 2 + n, 1, "f")), root)
    now, want = store.current(spark, root), _held(spark, root)
    hold = store.hold(spark, root, 2)
    seen = {tuple(r) for r in store.read_events(spark, root, 2).collect()}
    assert store.expire_versions(spark, root, keep_seconds=3_600) == [] and len(store.pointers(spark, root)) == 4
    store.expire_versions(spark, root, keep_seconds=0, now=now.at + 10)
    assert store.pointers(spark, root) == [2, 4] and _held(spark, root) == want
    assert {tuple(r) for r in store.read_events(spark, root, 2).collect()} == seen
    store.release(spark, root, hold)
    store.expire_versions(spark, root, keep_seconds=0, now=now.at + 10)
    folders = {(v, x) for v in storage.names(spark, f"{root}/events") for x in storage.names(spark, f"{root}/events/{v}/source_id=a")}
    assert store.pointers(spark, root) == [4] and _held(spark, root) == want and len(folders) == 5
    _hours_are_right(spark, root)
    store.write_events(_events(spark, ("a", "k0", 2, 9, "f")), root)
    assert len(_held(spark, root)) == 5


def test_expiry_takes_versions_that_outlived_their_commit(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    first = store.write_events(_events(spark, ("a", "k1", 1, 1, "f"), ("a", "k2", 2, 1, "f")), root)
    store.write_events(_events(spark, ("a", "k1", 1, 2, "f")), root)
    assert store.expire_versions(spark, root, 0, now=store.current(spark, root).at + 10) == []  # day 2 stands in the first version yet
    store.write_events(_events(spark, ("a", "k2", 2, 2, "f")), root)
    assert store.expire_versions(spark, root, 0, now=store.current(spark, root).at + 10) == [first]
    assert f"version={first}" not in storage.names(spark, f"{root}/events") and _held(spark, root) == {("a", "k1", 1, 2, "f"), ("a", "k2", 2, 2, "f")}


def test_small_versions_are_put_together(spark, tmp_path):
    root, out = f"file://{tmp_path}/s", f"file://{tmp_path}/out"
    assert store.compact_versions(spark, root) is None
    for n in range(2):
        store.write_events(_events(spark, ("a", f"k{n}", 1 + n, n, f"f{n}"), ("b", f"k{n}", 9, n, f"f{n}")), root, _state(spark, (f"f{n}", n)))
    store.publish_store(spark, root, out, "dev", "now")
    want, days, state = _held(spark, root), _revisions(store.read_days(spark, root)), {tuple(r) for r in store.read_state(spark, root).collect()}
    version = store.compact_versions(spark, root)
    now = store.current(spark, root)
    assert now.number == 3 and {r["version"] for r in store._listing(spark, root, now).collect()} == {version}
    assert store.dirty_days(spark, root, out).isEmpty() and store.compact_versions(spark, root) is None
    assert len(store.expire_versions(spark, root, 0, now=now.at + 10)) == 2
    assert storage.names(spark, f"{root}/events") == [f"version={version}"] and len(storage.names(spark, f"{root}/listings")) == 1
    assert _held(spark, root) == want and _revisions(store.read_days(spark, root)) == days and {tuple(r) for r in store.read_state(spark, root).collect()} == state
    _hours_are_right(spark, root)
    store.write_events(_events(spark, ("a", "k0", 7, 50, "f9")), root, removed=spark.createDataFrame([("f1",)], "file_path string"))
    assert _held(spark, root) == {x for x in want if x[1] != "k1" and x[:2] != ("a", "k0")} | {("a", "k0", 7, 50, "f9")}
    _hours_are_right(spark, root)


@pytest.mark.parametrize("last", [1, 2])
def test_moving_meets_a_writer(spark, tmp_path, between, last):
    root = f"file://{tmp_path}/s"
    for n in range(1, 3):
        store.write_events(_events(spark, ("a", f"k{n}", n, n, "f")), root)
    between(lambda: [store.write_events(_events(spark, ("a", f"k{n}", n, n + 10, "g")), root) for n in range(1, last + 1)])
    version = store.compact_versions(spark, root)
    assert (version is None) == (last == 2)  # every partition has been written by someone else
    assert _held(spark, root) == {("a", f"k{n}", n, n + 10 * (n <= last), "g" if n <= last else "f") for n in range(1, 3)}
    assert {r["day_utc"].day: r["version"] == version for r in store._listing(spark, root, store.current(spark, root)).collect()} == {n: n > last for n in range(1, 3)}
    store.expire_versions(spark, root, 0, now=store.current(spark, root).at + 10)
    assert len(_held(spark, root)) == 2
    _hours_are_right(spark, root)


@pytest.mark.parametrize("day", [2, 8])
def test_writer_meets_a_move(spark, tmp_path, between, day):
    root = f"file://{tmp_path}/s"
    for n in range(1, 3):
        store.write_events(_events(spark, ("a", f"k{n}", n, n, "f")), root)
    merges = between(lambda: store.compact_versions(spark, root))
    store.write_events(_events(spark, ("a", "k9", day, 9, "f")), root)
    assert _held(spark, root) == {*(("a", f"k{n}", n, n, "f") for n in range(1, 3)), ("a", "k9", day, 9, "f")}
    assert len(merges) == (3 if day == 2 else 2)  # a moved partition is merged again, others are not
    _hours_are_right(spark, root)
