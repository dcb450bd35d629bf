"""Reports over usage rows in the common shape of ``all_usage``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..schema import TOKENS
from .filters import ACTIVITY_DAYS, local_day

MEASURES = (*TOKENS, "cost_usd", "event_count", "estimated_count")


def all_usage(local: DataFrame, device_id: str | Column, remote: DataFrame | None = None) -> DataFrame:
    """Local events (one each) and remote hour buckets (counted already) in one shape."""
    device = F.lit(device_id) if isinstance(device_id, str) else device_id
    shape = ["device_id", "timestamp_utc", "source_id", "model_family", *MEASURES]
    one = local.withColumns({"device_id": device, "event_count": F.lit(1).cast("bigint"), "estimated_count": F.col("cost_is_estimated").cast("int").cast("bigint")}).select(shape)
    if remote is None:
        return one
    two = remote.withColumnsRenamed({"hour_utc": "timestamp_utc", "estimated_event_count": "estimated_count"}).select(shape)
    return one.unionByName(two)


def _sums(*columns: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def daily_summary(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """(local day, source): token sums and cost, by day."""
    return df.groupBy(local_day(F.col("timestamp_utc"), tz).alias("day"), "source_id").agg(*_sums(*TOKENS, "cost_usd")).orderBy("day", "source_id")


def model_breakdown(df: DataFrame) -> DataFrame:
    """(family, source): sums and counts, dearest first."""
    return df.groupBy("model_family", "source_id").agg(*_sums(*MEASURES)).orderBy(F.desc("cost_usd"), "model_family", "source_id")


def project_breakdown(events: DataFrame, approximate: bool = False) -> DataFrame:
    """(project, source) of local events: sums, events and distinct sessions, dearest first; no project is ''."""
    sessions = F.approx_count_distinct("session_id") if approximate else F.count_distinct("session_id")
    key = F.coalesce("project_or_workspace", F.lit("")).alias("project")
    return events.groupBy(key, "source_id").agg(*_sums(*TOKENS, "cost_usd"), F.count(F.lit(1)).alias("event_count"), sessions.alias("session_count")).orderBy(F.desc("cost_usd"), "project", "source_id")


def device_breakdown(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Sums of each device, by name without case. Usage is summed before it meets the names."""
    sums = df.groupBy("device_id").agg(*_sums(*MEASURES))
    return sums.join(devices.select("device_id", "device_name"), "device_id").orderBy(F.lower("device_name"), "device_id")


def hourly_rollup(events: DataFrame) -> DataFrame:
    """(UTC hour, source, family): sums, events and estimated events."""
    return events.groupBy(F.date_trunc("hour", "timestamp_utc").alias("hour_utc"), "source_id", "model_family").agg(
        *_sums(*TOKENS, "cost_usd"), F.count(F.lit(1)).alias("event_count"), F.count_if("cost_is_estimated").alias("estimated_event_count")
    )


def source_totals(df: DataFrame) -> DataFrame:
    """Sums of each source and whether any of its cost is estimated."""
    return df.groupBy("source_id").agg(*_sums(*MEASURES)).withColumns({"total_tokens": K.total(), "has_estimated": F.col("estimated_count") > 0})


def grand_total(df: DataFrame) -> DataFrame:
    """One row with all sums; with ``source_totals`` in one pass: ``totals_rollup``."""
    return df.agg(*_sums(*MEASURES)).withColumns({"total_tokens": K.total(), "has_estimated": F.col("estimated_count") > 0})


def totals_rollup(df: DataFrame) -> DataFrame:
    """Sums of each source and, with a null source and ``is_total``, of all."""
    return df.rollup("source_id").agg(*_sums(*MEASURES), (F.grouping("source_id") == 1).alias("is_total")).withColumn("total_tokens", K.total())


def period_comparison(df: DataFrame, start: Column, end: Column, tz: str = "UTC") -> DataFrame:
    """Tokens, cost and events of a range and of the range of equal length before it, in one pass."""
    day, days = local_day(F.col("timestamp_utc"), tz), F.datediff(end, start) + 1
    now, before = day.between(start, end), day.between(F.date_sub(start, days), F.date_sub(start, F.lit(1)))
    total = K.total()
    out = []
    for name, when in (("current", now), ("previous", before)):
        out += [F.sum(F.when(when, total)).alias(f"{name}_tokens"), F.sum(F.when(when, F.col("cost_usd"))).alias(f"{name}_cost"), F.sum(F.when(when, F.col("event_count"))).alias(f"{name}_events")]
    return df.filter(now | before).agg(*out)


def active_days(df: DataFrame, tz: str = "UTC") -> DataFrame:
    return df.agg(F.count_distinct(local_day(F.col("timestamp_utc"), tz)).alias("active_days"))


def activity_heatmap(df: DataFrame, today: Column, tz: str = "UTC", days: int = ACTIVITY_DAYS) -> DataFrame:
    """``day, week, total_tokens, cost_usd, level`` of every day of the activity range; days without usage are 0.

    Level 0 has no tokens; 1 to 4 are quarters of the largest day.
    """
    first = F.date_sub(today, days - 1)
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(first, today)).alias("day"))
    used = df.groupBy(local_day(F.col("timestamp_utc"), tz).alias("day")).agg(F.sum(K.total()).alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"))
    out = spine.join(used, "day", "left").withColumns({"total_tokens": F.coalesce("total_tokens", F.lit(0).cast("bigint")), "cost_usd": F.coalesce("cost_usd", F.lit(0).cast("decimal(30,12)"))})
    share = F.col("total_tokens") / F.max("total_tokens").over(Window.partitionBy(F.lit(0)))  # a row for each day of the range, no more
    level = F.when(F.col("total_tokens") == 0, 0).when(share < 0.25, 1).when(share < 0.5, 2).when(share < 0.75, 3).otherwise(4)
    return out.withColumns({"week": F.floor(F.datediff("day", first) / 7).cast("bigint"), "level": level}).orderBy("day")


def ambiguous_models(df: DataFrame) -> DataFrame:
    """Families that more than one source reports, with their sources."""
    return df.select("model_family", "source_id").distinct().groupBy("model_family").agg(F.count(F.lit(1)).alias("sources")).filter("sources > 1")


DATE_LIKE = r"^\d{4}[/-]\d{2}[/-]\d{2}$"


def abbreviate_home(path: Column, home: str) -> Column:
    """The path with the home folder as ``~``."""
    if not home:
        return path
    return F.when(path == home, F.lit("~")).when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def resolve_projects(projects: DataFrame, known_dirs: DataFrame, home: str = "") -> DataFrame:
    """``raw, project_key, title, subtitle`` of distinct ``raw`` project names.

    Empty and date-like names have a null key (ungrouped). A name that starts with ``-`` is a
    path with ``/`` spelt ``-``; it stands for the known directory of that spelling, of several
    the one whose first differing part is longest; without one the raw name stays the key.
    """
    raw = F.col("raw")
    dirs = known_dirs.select(F.col("path"), F.translate("path", "/", "-").alias("spelling"))
    lengths = F.transform(F.split("path", "/"), F.length)
    dirs = dirs.groupBy("spelling").agg(F.max_by("path", F.struct(lengths.alias("parts"), "path")).alias("path"))
    out = projects.select("raw").distinct().join(dirs, (F.col("raw") == F.col("spelling")) & raw.startswith("-"), "left")
    munged, absolute = raw.startswith("-"), raw.startswith("/")
    ungrouped = (raw == "") | raw.rlike(DATE_LIKE)
    shown = F.when(munged, F.coalesce("path", F.translate("raw", "-", "/"))).when(absolute, raw)
    last = F.element_at(F.filter(F.split(shown, "/"), lambda p: p != ""), -1)
    title = F.when(shown.isNotNull(), F.coalesce(last, shown)).otherwise(raw)
    keep = lambda c: F.when(~ungrouped, c)
    return out.select("raw", keep(F.coalesce(F.when(munged, F.col("path")), raw)).alias("project_key"), keep(title).alias("title"), keep(abbreviate_home(shown, home)).alias("subtitle"))


def project_rollup(events: DataFrame, known_dirs: DataFrame, home: str = "") -> DataFrame:
    """Sums by canonical project; names are resolved once each. Ungrouped usage has a null key."""
    named = events.withColumn("raw", F.coalesce("project_or_workspace", F.lit("")))
    sums = named.groupBy("raw").agg(*_sums(*TOKENS, "cost_usd"), F.count(F.lit(1)).alias("event_count"))
    found = sums.join(resolve_projects(sums, known_dirs, home), "raw")
    return found.groupBy("project_key").agg(F.min("title").alias("title"), F.min("subtitle").alias("subtitle"), *_sums(*TOKENS, "cost_usd", "event_count")).orderBy(F.desc("cost_usd"), "project_key")


def latest_sources(events: DataFrame, at: str = "timestamp_utc") -> DataFrame:
    """First time each source was seen."""
    return events.groupBy("source_id").agg(F.min(at).alias("first_seen_at"))


def known_sources(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select("source_id").union(remote.select("source_id")).distinct()
