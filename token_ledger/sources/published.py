"""Price snapshots and published day documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exchange import day_checksum
from ..operators.pricing import override_merge, per_token
from ..schema import MONEY, TOKENS

_RATE = "map<string,struct<inputPerMillion:decimal(14,6),outputPerMillion:decimal(14,6),cacheWritePerMillion:decimal(14,6),cacheReadPerMillion:decimal(14,6)>>"


def parse_price_snapshot(docs: DataFrame) -> DataFrame:
    """Price rows of JSON maps (family -> rates a million) in ``value``."""
    rows = docs.select(F.explode(F.from_json("value", _RATE)).alias("family", "r"))
    return rows.select("family", per_token(F.col("r.inputPerMillion")).alias("input_rate"), per_token(F.col("r.outputPerMillion")).alias("output_rate"), per_token(F.col("r.cacheWritePerMillion")).alias("cache_write_rate"), per_token(F.col("r.cacheReadPerMillion")).alias("cache_read_rate"))


def read_price_snapshot(spark: SparkSession, *paths: str) -> DataFrame:
    """Price rows; a later path's families override an earlier one's."""
    out = None
    for path in paths:
        rows = parse_price_snapshot(spark.read.text(path, wholetext=True))
        out = rows if out is None else override_merge(out, rows)
    return out


DAY_DOCUMENT = "schemaVersion int, deviceID string, day string, generatedAt string, buckets array<struct<hourUTC:string,sourceID:string,modelFamily:string,tokens:struct<input:bigint,output:bigint,cacheCreate:bigint,cacheRead:bigint,reasoning:bigint>,costUSD:string,eventCount:bigint,estimatedEventCount:bigint>>"


def _from_path(*patterns: str) -> Column:
    """What the first matching pattern captures of the file's path."""
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.coalesce(*(F.nullif(F.regexp_extract(at, p, 1), F.lit("")) for p in patterns))


def read_day_documents(spark: SparkSession, path: str) -> DataFrame:
    """Day documents as ``verify_days`` takes them, with the checksum that their buckets give.

    The path's device and day stand in ``device_id=…/day_utc=…`` or ``…/<device>/days/<day>.json``.
    """
    raw = spark.read.schema(DAY_DOCUMENT).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.{json,txt}").json(path)
    names = ("input", "output", "cacheCreate", "cacheRead", "reasoning")
    bucket = F.transform(
        "buckets",
        lambda b: F.struct(
            F.col("deviceID").alias("device_id"), F.try_to_timestamp(b["hourUTC"]).alias("hour_utc"), b["sourceID"].alias("source_id"), b["modelFamily"].alias("model_family"), *(b["tokens"][n].alias(t) for n, t in zip(names, TOKENS, strict=True)), b["costUSD"].try_cast(MONEY).alias("cost_usd"), b["eventCount"].alias("event_count"), b["estimatedEventCount"].alias("estimated_event_count")
        ),
    )
    docs = raw.select(
        _from_path(r"([^/]+)/days/[^/]+\.json$", r"/device_id=([^/]+)/").alias("path_device"), _from_path(r"/days/([^/]+)\.json$", r"/day_utc=([^/]+)/").alias("path_day"), F.col("schemaVersion").alias("schema_version"), F.col("deviceID").alias("device_id"), F.col("day").alias("day_utc"), bucket.alias("buckets")
    )
    sums = day_checksum(docs.select(F.explode("buckets").alias("b")).select("b.*")).select("device_id", "day_utc", F.col("checksum").alias("computed_checksum"))
    return docs.join(sums, ["device_id", "day_utc"], "left")


def day_documents(buckets: DataFrame, generated_at: str) -> DataFrame:
    """``device_id, day_utc, document`` (JSON) of hour buckets; costs are strings, to stay exact."""
    tokens = F.struct(*(F.col(t).alias(n) for n, t in zip(("input", "output", "cacheCreate", "cacheRead", "reasoning"), TOKENS, strict=True)))
    one = F.struct(F.date_format("hour_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("hourUTC"), F.col("source_id").alias("sourceID"), F.col("model_family").alias("modelFamily"), tokens.alias("tokens"), F.col("cost_usd").cast("string").alias("costUSD"), F.col("event_count").alias("eventCount"), F.col("estimated_event_count").alias("estimatedEventCount"))
    days = buckets.groupBy("device_id", F.date_format("hour_utc", "yyyy-MM-dd").alias("day_utc")).agg(F.array_sort(F.collect_list(one)).alias("buckets"))
    doc = F.struct(F.lit(1).alias("schemaVersion"), F.col("device_id").alias("deviceID"), F.col("day_utc").alias("day"), F.lit(generated_at).alias("generatedAt"), "buckets")
    return days.select("device_id", "day_utc", F.to_json(doc).alias("document"))


PROFILE = "schemaVersion int, deviceID string, name string, lastSyncedAt string"


def profile_documents(profiles: DataFrame, synced_at: str) -> DataFrame:
    """``device_id, document`` (JSON) of ``device_id, name``."""
    doc = F.struct(F.lit(1).alias("schemaVersion"), F.col("device_id").alias("deviceID"), "name", F.lit(synced_at).alias("lastSyncedAt"))
    return profiles.select("device_id", F.to_json(doc).alias("document"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``device_id, device_name, updated_at`` of profile documents, as ``device_registry`` takes them."""
    raw = spark.read.schema(PROFILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,txt}").json(path)
    return raw.filter("schemaVersion = 1").select(F.col("deviceID").alias("device_id"), F.col("name").alias("device_name"), F.try_to_timestamp("lastSyncedAt").alias("updated_at"))
