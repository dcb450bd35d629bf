"""Tables on storage: versioned events with what is derived from them, published days, cached devices.

Parquet has no merge, so a change is a new version that holds the changed (source, day)
partitions only: their events, and beside them their hours and two small indexes, of key
fingerprints and of files. A listing says in which version each partition stands now; a numbered pointer,
created only if no other commit has taken the number, makes all of it visible at once. A
commit that comes second looks at what came between: if that changed none of its partitions
and brought none of its keys, only listing, day revisions and file state are written again on
top of it, else the merge is done again. Small versions are put together by
``compact_versions``, old ones go by ``expire_versions``. Partitions
that stand alone (device and day) are overwritten one by one. A path that is being read is
never overwritten.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import changed_days, upsert_sides
from ..operators.exchange import day_checksum, days_to_publish, utc_day
from ..operators.rollup import hourly_rollup
from ..schema import HOUR_BUCKET, MONEY
from ..session import staged
from ..sources.published import day_documents, profile_documents
from . import storage

PARTITION = ("source_id", "day_utc")
_LISTING = "source_id string, day_utc date, version string"
_DAYS = "day_utc date, revision bigint"
_PLACE = "version string, source_id string, day_utc date"
#: Tables of a version, by partition, with their columns; those of events stand in the pointer.
PARTS = {"events": "", "hours": HOUR_BUCKET.removeprefix("device_id string, ").replace(" source_id string,", ""), "keys": "fingerprint int", "files": "source_file_path string"}


@dataclass(frozen=True)
class Pointer:
    """What a commit made visible: its number, the version it wrote, and the tables over all partitions."""

    number: int
    version: str
    listing: str
    days: str
    state: str
    columns: str
    at: float


def pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the commits that are kept."""
    return [int(n.removesuffix(".json")) for n in storage.names(spark, f"{root}/pointers") if n.endswith(".json") and not n.startswith(".")]


def pointer(spark: SparkSession, root: str, number: int) -> Pointer:
    return Pointer(**json.loads(storage.read_text(spark, f"{root}/pointers/{number:012d}.json")))


def current(spark: SparkSession, root: str) -> Pointer | None:
    """The newest commit; None for a new store."""
    numbers = pointers(spark, root)
    return pointer(spark, root, max(numbers)) if numbers else None


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version that the newest commit wrote; None for a new store."""
    now = current(spark, root)
    return now.version if now else None


def _listing(spark: SparkSession, root: str, at: Pointer) -> DataFrame:
    """``source_id, day_utc, version``: where each partition stands."""
    return spark.read.schema(_LISTING).parquet(f"{root}/{at.listing}")


def _table(spark: SparkSession, root: str, at: Pointer, table: str) -> DataFrame:
    """A table of all versions and partitions."""
    return spark.read.schema(f"{PARTS[table] or at.columns}, {_PLACE}").parquet(f"{root}/{table}")


def _part(spark: SparkSession, root: str, at: Pointer, table: str) -> DataFrame:
    """A table of all partitions as they stood at a commit; versions that are being written or deleted meanwhile are not read."""
    listing = _listing(spark, root, at)
    versions = [r[0] for r in listing.select("version").distinct().collect()]
    rows = _table(spark, root, at, table).filter(F.col("version").isin(versions) if versions else F.lit(False))
    # A listing has a row for each source and day; Spark broadcasts it and prunes partitions by it.
    return rows.join(listing, ["version", *PARTITION], "left_semi").drop("version")


def _partitions(spark: SparkSession, root: str, at: Pointer, table: str, wanted: DataFrame) -> DataFrame:
    """A table of the wanted partitions as they stood at a commit; the scan lists and reads those only."""
    name = F.concat_ws("/", "version", "source_id", F.col("day_utc").cast("string"))
    found = [r[0] for r in _listing(spark, root, at).join(wanted.select(*PARTITION).distinct(), list(PARTITION), "left_semi").select(name).collect()]  # names of partitions
    return _table(spark, root, at, table).filter(name.isin(found) if found else F.lit(False)).drop("version")


def read_events(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The events of the newest commit, or of one that is kept, with ``day_utc``; None for a new store."""
    at = current(spark, root) if number is None else pointer(spark, root, number)
    return _part(spark, root, at, "events") if at else None


def read_hours(spark: SparkSession, root: str, days: DataFrame | None = None, number: int | None = None) -> DataFrame | None:
    """The hourly roll-up of the store (of the given ``day_utc`` only), kept up to date by every commit; None for a new store."""
    at = current(spark, root) if number is None else pointer(spark, root, number)
    if at is None:
        return None
    hours = _part(spark, root, at, "hours") if days is None else _partitions(spark, root, at, "hours", _listing(spark, root, at).join(days.select("day_utc").distinct(), "day_utc", "left_semi"))
    return hours.drop("day_utc")


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """File state of the newest commit; None if there is none."""
    at = current(spark, root)
    return spark.read.parquet(f"{root}/{at.state}") if at else None


def read_days(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """``day_utc, revision``: how many commits have changed each day; None for a new store."""
    at = current(spark, root) if number is None else pointer(spark, root, number)
    return spark.read.schema(_DAYS).parquet(f"{root}/{at.days}") if at else None


def _fingerprint(key: Column) -> Column:
    return F.hash(key).alias("fingerprint")


def _holding(spark: SparkSession, root: str, at: Pointer, table: str, by: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``source_id, day_utc`` of partitions whose index may hold what comes in (a fingerprint has false hits, no misses)."""
    index = _part(spark, root, at, table) if only is None else _partitions(spark, root, at, table, only)
    return index.join(by, by.columns, "left_semi").select(*PARTITION).distinct()


def _version_tables(merged: DataFrame) -> dict[str, DataFrame]:
    """Events, hours and indexes of the partitions that rows make up."""
    return {
        "events": merged,
        "hours": hourly_rollup(merged).withColumns({"cost_usd": F.col("cost_usd").cast(MONEY), "day_utc": F.to_date("hour_utc")}),
        "keys": merged.select(*PARTITION, _fingerprint(F.col("dedup_key"))).distinct(),
        "files": merged.select(*PARTITION, "source_file_path").distinct(),
    }


def _write_version(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """The tables of a version; a large partition is dealt over many tasks. Every version, merged or moved, is written here."""
    for name, rows in tables.items():
        rows, place = rows.hint("rebalance", *PARTITION), f"{root}/{name}/version={version}"
        if name == "events":
            rows.write.partitionBy(*PARTITION).parquet(place)
        else:
            rows.sortWithinPartitions(*PARTITION).write.parquet(place)


def write_events(incoming: DataFrame, root: str, state: DataFrame | None = None, removed: DataFrame | None = None, tries: int = 50) -> str:
    """Merges a scan into the store and returns its version; other writers may commit meanwhile.

    Written anew are the partitions that rows come into, those that may hold a key that comes
    in, and those that hold rows of ``removed`` files (``file_path``: reset or gone), whose
    rows and state go in the same commit. State that comes in replaces that of the same
    ``file_path``; other files keep theirs. A day's revision goes up if a commit changes any of its rows.
    """
    spark = incoming.sparkSession
    incoming = staged(incoming.withColumn("day_utc", F.to_date("timestamp_utc")), "store-incoming")
    keys = incoming.select("source_id", _fingerprint(F.col("dedup_key"))).distinct()
    gone = None if removed is None else staged(removed.select(F.col("file_path").alias("source_file_path")).distinct(), "store-removed")
    state = None if state is None else staged(state, "store-state")

    base, version = current(spark, root), None
    for _ in range(tries):
        if version is None:
            version = uuid.uuid4().hex
            merged, touched, days = _merged(spark, root, base, incoming, keys, gone)
            _write_version(_version_tables(merged), root, version)
        at = _commit_tables(spark, root, base, version, merged, touched, days, state, gone)
        if storage.create_once(spark, f"{root}/pointers/{at.number:012d}.json", json.dumps(asdict(at))):
            return version
        now = current(spark, root)
        if _conflicts(spark, root, base, now, touched, keys, gone):
            for name in PARTS:
                storage.delete(spark, f"{root}/{name}/version={version}")
            version = None
        base = now
    raise RuntimeError(f"no commit after {tries} tries")


def _merged(spark: SparkSession, root: str, base: Pointer | None, incoming: DataFrame, keys: DataFrame, gone: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of all partitions that are written, those partitions, days of which rows change)."""
    touched = incoming.select(*PARTITION).distinct()
    if base is None:
        return staged(upsert_sides(incoming.limit(0), incoming).drop("_side"), "store-merged"), touched, touched.select("day_utc").distinct()
    touched = touched.unionByName(_holding(spark, root, base, "keys", keys))
    if gone is not None:
        touched = touched.unionByName(_holding(spark, root, base, "files", gone))
    touched = staged(touched.distinct(), "store-touched")
    old = kept = _partitions(spark, root, base, "events", touched).select(*incoming.columns)
    if gone is not None:
        kept = old.join(gone, "source_file_path", "left_anti").select(*incoming.columns)
    sides = upsert_sides(kept, incoming)
    if gone is not None:
        sides = sides.unionByName(old.join(gone, "source_file_path", "left_semi").select(*incoming.columns).withColumn("_side", F.lit(-1)))
    # What has gone is staged with what stands, so that only rows that change are compared to tell their days.
    sides = staged(sides, "store-merged")
    return sides.filter("_side >= 0").drop("_side"), touched, staged(changed_days(sides).select("day_utc"), "store-days")


def _conflicts(spark: SparkSession, root: str, base: Pointer | None, now: Pointer, touched: DataFrame, keys: DataFrame, gone: DataFrame | None) -> bool:
    """Whether commits since ``base`` changed a partition that was merged here, or brought a key or a removed file's rows elsewhere."""
    theirs = _listing(spark, root, now)
    if base is not None:
        was = _listing(spark, root, base)
        theirs = theirs.join(was, [*PARTITION, "version"], "left_anti").select(*PARTITION).unionByName(was.join(theirs, list(PARTITION), "left_anti").select(*PARTITION))
    theirs = staged(theirs.select(*PARTITION).distinct(), "store-theirs")
    if not theirs.join(touched, list(PARTITION), "left_semi").isEmpty():
        return True
    if not _holding(spark, root, now, "keys", keys, theirs).isEmpty():
        return True
    return gone is not None and not _holding(spark, root, now, "files", gone, theirs).isEmpty()


def _commit_tables(spark: SparkSession, root: str, base: Pointer | None, version: str, merged: DataFrame, touched: DataFrame, days: DataFrame, state: DataFrame | None, gone: DataFrame | None) -> Pointer:
    """Listing, day revisions and file state over all partitions, on top of ``base``."""
    number = base.number + 1 if base else 1
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema if f.name not in PARTITION)
    at = Pointer(number, version, *(f"{t}/{number:012d}-{version}" for t in ("listings", "days", "state")), columns, time.time())
    # A partition that has lost all its rows has no keys and leaves the listing.
    mine = _table(spark, root, at, "keys").filter(F.col("version") == version).select(*PARTITION, "version").distinct()
    days = days.withColumn("_one", F.lit(1).cast("bigint"))
    if base is None:
        listing, days = mine, days.select("day_utc", F.col("_one").alias("revision"))
        kept = state if state is not None else spark.createDataFrame([], "file_path string")
    else:
        listing = _listing(spark, root, base).join(touched, list(PARTITION), "left_anti").select(*PARTITION, "version").unionByName(mine)
        was = spark.read.schema(_DAYS).parquet(f"{root}/{base.days}")
        days = was.join(days, "day_utc", "full").select("day_utc", (F.coalesce("revision", F.lit(0)) + F.coalesce("_one", F.lit(0))).alias("revision"))
        kept = spark.read.parquet(f"{root}/{base.state}")
        if gone is not None:
            kept = kept.join(gone.withColumnRenamed("source_file_path", "file_path"), "file_path", "left_anti")
        if state is not None:
            kept = kept.join(state.select("file_path"), "file_path", "left_anti").unionByName(state, allowMissingColumns=True)
    listing.write.mode("overwrite").parquet(f"{root}/{at.listing}")
    days.write.mode("overwrite").parquet(f"{root}/{at.days}")
    kept.write.mode("overwrite").parquet(f"{root}/{at.state}")
    return at


def compact_versions(spark: SparkSession, root: str, fewest: int = 64, tries: int = 50) -> str | None:
    """Moves the partitions of versions that list fewer than ``fewest`` into one version, as a commit; returns it, or None if there was nothing to gain.

    Many small commits leave a partition here and there in many versions, whose folders and
    small files every read lists. Rows, file state and day revisions stay as they are, so
    nothing is published again. Other writers may commit meanwhile: a partition that one of
    them has written is left to it. The old versions go by ``expire_versions``.
    """
    base = current(spark, root)
    if base is None:
        return None
    listing = _listing(spark, root, base)
    few = listing.groupBy("version").count().filter(F.col("count") < fewest).select("version")
    due = staged(listing.join(few, "version", "left_semi").select(*PARTITION, "version"), "store-small")
    if due.select("version").distinct().limit(2).count() < 2:
        return None
    version = uuid.uuid4().hex
    # Hours and indexes are those of the same rows: they are moved like these, not told anew.
    _write_version({name: _partitions(spark, root, base, name, due) for name in PARTS}, root, version)
    for _ in range(tries):
        listing = _listing(spark, root, base)
        still = listing.join(due, [*PARTITION, "version"], "left_semi").select(*PARTITION, F.lit(version).alias("version"))
        if still.isEmpty():
            break
        number = base.number + 1
        at = Pointer(number, version, f"listings/{number:012d}-{version}", base.days, base.state, base.columns, time.time())
        listing.join(still.select(*PARTITION), list(PARTITION), "left_anti").select(*PARTITION, "version").unionByName(still).write.mode("overwrite").parquet(f"{root}/{at.listing}")
        if storage.create_once(spark, f"{root}/pointers/{number:012d}.json", json.dumps(asdict(at))):
            return version
        base = current(spark, root)
    for name in PARTS:
        storage.delete(spark, f"{root}/{name}/version={version}")
    return None


def hold(spark: SparkSession, root: str, number: int) -> str:
    """Keeps a commit readable until ``release``; the name to release it by."""
    name = f"{number:012d}-{uuid.uuid4().hex}"
    storage.create_once(spark, f"{root}/holds/{name}", "")
    pointer(spark, root, number)  # it was there after the hold was, so no expiry has missed the hold
    return name


def release(spark: SparkSession, root: str, name: str) -> None:
    storage.delete(spark, f"{root}/holds/{name}")


def expire_versions(spark: SparkSession, root: str, keep_seconds: float, now: float | None = None) -> list[str]:
    """Deletes commits older than ``keep_seconds`` and the partitions that no kept commit lists; returns the versions that are gone.

    Kept are the newest commit, held ones, and every commit that was the newest at some time
    in the last ``keep_seconds``, so a reader or writer that takes less time is not disturbed.
    """
    found = [pointer(spark, root, n) for n in sorted(pointers(spark, root))]
    now, held = time.time() if now is None else now, {int(n.split("-")[0]) for n in storage.names(spark, f"{root}/holds") if not n.startswith(".")}
    replaced = [later.at for later in found[1:]]
    keep = [p for p, end in zip(found, [*replaced, now], strict=True) if end >= now - keep_seconds or p is found[-1] or p.number in held]
    drop = [p for p in found if p not in keep]
    listed = lambda ps: {(r["version"], r["source_id"], str(r["day_utc"])) for r in reduce(DataFrame.unionByName, [_listing(spark, root, p) for p in ps]).distinct().collect()}  # noqa: E731 (names of partitions)
    if not drop:
        return []
    used, tables = listed(keep), {t for p in keep for t in (p.listing, p.days, p.state)}
    # A version outlives its own commit as long as a later one lists some of it, so what goes is what the dropped ones listed.
    kept, old, gone = {v for v, _, _ in used}, {p.version for p in drop} | {v for v, _, _ in listed(drop) - used}, []
    for p in drop:  # first the pointers: from now on nobody starts to read these
        storage.delete(spark, f"{root}/pointers/{p.number:012d}.json")
    for version in old - kept:
        for table in PARTS:
            storage.delete(spark, f"{root}/{table}/version={version}")
        gone.append(version)
    at = F.col("_metadata.file_path")
    for version in old & kept:  # some of its partitions are listed yet
        rows = _table(spark, root, found[-1], "events").filter(F.col("version") == version)
        for r in rows.select("source_id", F.col("day_utc").cast("string").alias("day"), F.regexp_replace(at, "/[^/]*$", "").alias("folder")).distinct().collect():
            if (version, r["source_id"], r["day"]) not in used:
                storage.delete(spark, r["folder"])
    for table in {t for p in drop for t in (p.listing, p.days, p.state)} - tables:  # a commit that has only moved rows shares those before it
        storage.delete(spark, f"{root}/{table}")
    return sorted(gone)


_MANIFEST = "device_id string, day_utc string, checksum string, bucket_count bigint"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest on storage, or none."""
    if not storage.names(spark, f"{root}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def publish_days(buckets: DataFrame, root: str, published: DataFrame, generated_at: str, profiles: DataFrame | None = None, revisions: DataFrame | None = None, clean: DataFrame | None = None) -> DataFrame:
    """Writes new and changed device-days as documents, deletes those that are empty now, then writes manifest and profiles; returns the changes.

    ``profiles`` has ``device_id, name`` of the devices that publish. ``revisions``
    (``day_utc, revision``) tells of which revisions the buckets are: a day that has been
    published from a later revision is left alone, and what is published is marked with its
    revision after its document stands, for ``dirty_days``. ``clean`` are rows of the manifest
    that stay, of days that the buckets do not cover. One publisher of a device runs at a time.
    """
    spark = buckets.sparkSession
    mine = staged(day_checksum(buckets), "publish-manifest")
    changes, stays = days_to_publish(mine, published), clean
    if revisions is not None:
        revisions = staged(revisions.select(F.col("day_utc").cast("string").alias("day_utc"), "revision"), "publish-revisions")
        later = published_revisions(spark, root).join(revisions, "day_utc").filter(F.col("published") > F.col("revision")).select("day_utc")
        later = staged(later, "publish-later")
        changes, mine, revisions = (df.join(later, "day_utc", "left_anti") for df in (changes, mine, revisions))
        theirs = _manifest(spark, root).join(later, "day_utc", "left_semi")
        stays = theirs if stays is None else stays.join(later, "day_utc", "left_anti").unionByName(theirs)
    changes = staged(changes.select("device_id", "day_utc", "checksum", "change"), "publish-changes")
    due = changes.filter("change != 'gone'").select("device_id", "day_utc")
    fresh = buckets.withColumn("day_utc", utc_day(F.col("hour_utc"))).join(due, ["device_id", "day_utc"], "left_semi").drop("day_utc")
    day_documents(fresh, generated_at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_id", "day_utc").text(f"{root}/days")
    gone = changes.filter("change = 'gone'")
    for r in gone.select("device_id", "day_utc").toLocalIterator():  # names of emptied days only
        storage.delete(spark, f"{root}/days/device_id={r['device_id']}/day_utc={r['day_utc']}")
    listed = mine if stays is None else staged(mine.unionByName(stays.select(mine.columns)), "publish-listed")
    listed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_id").parquet(f"{root}/manifest")
    for r in gone.select("device_id").distinct().join(listed.select("device_id"), "device_id", "left_anti").toLocalIterator():
        storage.delete(spark, f"{root}/manifest/device_id={r['device_id']}")
    if profiles is not None:
        profile_documents(profiles, generated_at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_id").text(f"{root}/profiles")
    if revisions is not None:
        revisions.write.mode("append").parquet(f"{root}/published")
    return changes


def published_revisions(spark: SparkSession, root: str) -> DataFrame:
    """``day_utc`` (text), ``published``: the latest revision of each day that a document stands for."""
    if not storage.names(spark, f"{root}/published"):
        return spark.createDataFrame([], "day_utc string, published bigint")
    marks = spark.read.schema("day_utc string, revision bigint").parquet(f"{root}/published")
    return marks.groupBy("day_utc").agg(F.max("revision").alias("published"))


def dirty_days(spark: SparkSession, store: str, root: str, number: int | None = None) -> DataFrame:
    """``day_utc, revision`` of days of the store whose revision of now is not the published one; a write after the read of what was published leaves its day in here."""
    days = read_days(spark, store, number)
    if days is None:
        return spark.createDataFrame([], _DAYS)
    done = published_revisions(spark, root).withColumn("day_utc", F.to_date("day_utc"))
    return days.join(done, "day_utc", "left").filter(~F.coalesce(F.col("published") == F.col("revision"), F.lit(False))).select("day_utc", "revision")


def publish_store(spark: SparkSession, store: str, root: str, device_id: str, generated_at: str, profiles: DataFrame | None = None) -> DataFrame:
    """Publishes the dirty days of a store from its maintained hours; only their partitions are read. Returns the changes."""
    at = current(spark, store)
    if at is None:
        return spark.createDataFrame([], "device_id string, day_utc string, checksum string, change string")
    due = staged(dirty_days(spark, store, root, at.number), "publish-due")
    hours = read_hours(spark, store, due, at.number).withColumn("device_id", F.lit(device_id))
    before = _manifest(spark, root).filter(F.col("device_id") == device_id)
    days = due.select(F.col("day_utc").cast("string").alias("day_utc"))
    clean = staged(before.join(days, "day_utc", "left_anti"), "publish-clean")
    return publish_days(hours, root, before.join(days, "day_utc", "left_semi"), generated_at, profiles, due, clean)


def replace_device_day(buckets: DataFrame, root: str) -> None:
    """Overwrites just the device-days that come in."""
    buckets.withColumn("day_utc", utc_day(F.col("hour_utc"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_id", "day_utc").parquet(root)


def drop_device(buckets: DataFrame, devices: DataFrame) -> DataFrame:
    """Buckets without those of the given devices."""
    return buckets.join(devices.select("device_id").distinct(), "device_id", "left_anti")
