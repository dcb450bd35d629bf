"""Exchange of hourly roll-ups between devices: checksums, manifests, merge, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TOKENS

#: Fixed values of published documents.
SCHEMA_VERSION = 1
DEVICE_ID = r"^[\p{L}\p{M}\p{N}-]{1,128}$"
CHECKSUM = r"^[0-9a-f]{64}$"
CONTENT = ("source_id", "model_family", *TOKENS, "cost_usd", "event_count", "estimated_event_count")


def utc_day(hour: Column) -> Column:
    return F.date_format(hour, "yyyy-MM-dd")


def day_checksum(buckets: DataFrame) -> DataFrame:
    """``device_id, day_utc, checksum, bucket_count`` over a day's buckets in a fixed order.

    A device-day has at most 24 buckets for each source and family, so the gathered list is
    bounded; when it was made is not part of the content.
    """
    line = F.concat_ws("|", F.date_format("hour_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), *(F.col(c).cast("string") for c in CONTENT))
    return buckets.groupBy("device_id", utc_day(F.col("hour_utc")).alias("day_utc")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("checksum"), F.count(F.lit(1)).alias("bucket_count")
    )


def _diff(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """``device_id, day_utc, checksum, change``: new, changed or gone, seen from ``mine``."""
    a = mine.select("device_id", "day_utc", F.col("checksum").alias("_a"))
    b = theirs.select("device_id", "day_utc", F.col("checksum").alias("_b"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, ["device_id", "day_utc"], "full").select("device_id", "day_utc", F.coalesce("_a", "_b").alias("checksum"), change.alias("change")).filter("change IS NOT NULL")


def days_to_publish(mine: DataFrame, published: DataFrame) -> DataFrame:
    """Days of the local manifest that are new or changed, and published days that are empty now (gone)."""
    return _diff(mine, published)


def days_to_pull(remote: DataFrame, cached: DataFrame, own_id: str) -> DataFrame:
    """Days of other devices to fetch (new, changed) or to forget (gone)."""
    return _diff(remote.filter(F.col("device_id") != own_id), cached.filter(F.col("device_id") != own_id))


def merge_devices(cached: DataFrame, pulled: DataFrame, manifest: DataFrame, own_id: str) -> DataFrame:
    """Cached buckets with pulled days in place of their old ones; days and devices off the manifest go, as does the own id."""
    day = utc_day(F.col("hour_utc"))
    listed = manifest.select("device_id", "day_utc").distinct()
    fresh = pulled.withColumn("day_utc", day)
    kept = cached.withColumn("day_utc", day).join(fresh.select("device_id", "day_utc").distinct(), ["device_id", "day_utc"], "left_anti")
    return kept.unionByName(fresh).filter(F.col("device_id") != own_id).join(listed, ["device_id", "day_utc"], "left_semi").drop("day_utc")


def verify_days(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """``device_id, day_utc, ok, reason`` of day documents.

    ``docs``: ``path_device, path_day, schema_version, device_id, day_utc, buckets``
    (an array of bucket structs) and ``computed_checksum``. ``manifest``: ``device_id, day_utc,
    checksum``. The first rule that fails is the reason.
    """
    listed = manifest.groupBy("device_id", "day_utc").agg(F.count(F.lit(1)).alias("_n"), F.min("checksum").alias("_listed"))
    outside = F.exists("buckets", lambda b: F.coalesce(utc_day(b["hour_utc"]) != F.col("day_utc"), F.lit(True)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = (
        ("schema version", no(F.col("schema_version") == SCHEMA_VERSION)),
        ("device id", no(F.col("device_id").rlike(DEVICE_ID))),
        ("day", no(F.try_to_date("day_utc", "yyyy-MM-dd").isNotNull() & F.col("day_utc").rlike(r"^\d{4}-\d{2}-\d{2}$"))),
        ("path", no((F.col("path_device") == F.col("device_id")) & (F.col("path_day") == F.col("day_utc")))),
        ("hour outside day", F.coalesce(outside, F.lit(False))),
        ("manifest", no(F.col("_n") == 1)),
        ("checksum form", no(F.col("_listed").rlike(CHECKSUM))),
        ("checksum", no(F.col("_listed") == F.col("computed_checksum"))),
    )
    reason = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules))
    return docs.join(listed, ["device_id", "day_utc"], "left").select("device_id", "day_utc", reason.isNull().alias("ok"), reason.alias("reason"))


def valid_profile(name: Column, device_id: Column) -> Column:
    return device_id.rlike(DEVICE_ID) & (F.trim(name) != "") & (F.length(name) <= 200)


def device_registry(profiles: DataFrame, own_id: str) -> DataFrame:
    """Newest valid profile of each device (``device_id, device_name, updated_at``), the own one marked."""
    ok = profiles.filter(valid_profile(F.col("device_name"), F.col("device_id")))
    newest = ok.groupBy("device_id").agg(F.max_by("device_name", F.struct("updated_at", "device_name")).alias("device_name"), F.max("updated_at").alias("updated_at"))
    return newest.withColumn("is_local", F.col("device_id") == own_id)


def except_listed(cached: DataFrame, listed: DataFrame, *keys: str) -> DataFrame:
    """Cached rows whose keys are not listed any more."""
    return cached.join(listed.select(*keys).distinct(), list(keys), "left_anti")
