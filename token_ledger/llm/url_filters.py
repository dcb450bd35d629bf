"""URL filters with a temporal list join, in DataFrame operations only.

Dated list entries (key, time, action) become validity intervals: an entry holds until the
next entry of its key. Intervals are cut into time buckets, so the as-of join is an equality
join on (key, bucket) with a time condition. Captures look up their host, its parent domains
and their host with its first path segment. A key that holds more than 1/256 of all look-ups
is spread over salts; there are at most 256 such keys for each look-up kind, so only those
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 30
HOT_SHARE = 256
SALTS = 16
ACTIONS = ("block", "allow", "remove")


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and last dot; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), r"\.$", "")


def url_segment(url: Column) -> Column:
    """First path segment, as written; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def lookup_keys(host: Column, segment: Column) -> Column:
    """The host, its parent domains of two labels or more, and host/segment."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, own)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``key, action, valid_from, valid_to`` (null: open) from ``key, listed_at, action``.

    Rows with a null key or time are no entries. Of entries with one key and time, block goes
    before allow before remove. A removal ends the interval before it and opens none.
    """
    order = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("action"))
    one = entries.filter("key IS NOT NULL AND listed_at IS NOT NULL").groupBy("key", "listed_at").agg(F.min_by("action", order).alias("action"))
    to = F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at"))
    return one.withColumn("valid_to", to).filter("action IN ('block', 'allow')").select("key", "action", F.col("listed_at").alias("valid_from"), "valid_to")


def temporal_url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetch_time", bucket_days: int = BUCKET_DAYS, salts: int = SALTS) -> DataFrame:
    """``id_col, host, fetch_time, matched_key, action, valid_from, valid_to, blocked``, one row per capture.

    The longest key that has an entry active at the fetch time decides. Captures without a
    host, a fetch time or an active entry match nothing and are not blocked. Rows that repeat
    id, url and time are all returned. Other columns are not read; empty tables give an empty
    result (captures) or no match (entries).
    """
    seconds = bucket_days * 86400
    bucket = lambda t: F.floor(F.unix_timestamp(t.cast("timestamp")) / seconds)
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at")).groupBy("id", "url", "at").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("host", url_host(F.col("url")))
    looks = rows.select("id", "url", "at", "host", "copies", F.explode_outer(lookup_keys(F.col("host"), url_segment(F.col("url")))).alias("key"), bucket(F.col("at")).alias("bucket"))

    counted = captures.select(F.explode(lookup_keys(url_host(F.col(url_col)), url_segment(F.col(url_col)))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    lookups = captures.count()
    hot = F.broadcast(counted.filter(F.col("n") * HOT_SHARE > lookups).select("key", F.lit(True).alias("hot")))  # at most HOT_SHARE keys of each length

    last = captures.agg(bucket(F.max(time_col))).first()[0]
    spans = validity_intervals(entries)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("valid_from")), F.greatest(bucket(F.col("valid_from")), F.coalesce(bucket(F.col("valid_to")), F.lit(last or 0))))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "url"), F.lit(salts))).otherwise(F.lit(0))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    looks = looks.join(hot, "key", "left").withColumn("salt", salt.cast("int")).drop("hot")
    spans = spans.join(hot, "key", "left").withColumn("salt", F.explode(every)).drop("hot").withColumnRenamed("key", "matched_key")
    when = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    found = looks.join(spans.withColumnRenamed("bucket", "span_bucket").withColumnRenamed("salt", "span_salt"), (F.col("key") == F.col("matched_key")) & (F.col("bucket") == F.col("span_bucket")) & (F.col("salt") == F.col("span_salt")) & when, "left")
    best = found.groupBy("id", "url", "at").agg(
        F.first("host").alias("host"), F.first("copies").alias("copies"), F.max(F.when(F.col("matched_key").isNotNull(), F.struct(F.length("matched_key").alias("n"), "matched_key", "action", "valid_from", "valid_to"))).alias("m")
    )
    out = best.select("id", "host", "at", "m.matched_key", "m.action", "m.valid_from", "m.valid_to", F.coalesce(F.col("m.action") == "block", F.lit(False)).alias("blocked"), F.explode(F.expr("array_repeat(0, int(copies))")))
    return out.drop("col").withColumnsRenamed({"id": id_col, "at": time_col})
