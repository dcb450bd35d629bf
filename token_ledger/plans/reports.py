"""Report bundles: several small results over one filtered base."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import rollup as A
from ..operators.lookups import descriptor_join


def dashboard(usage: DataFrame, devices: DataFrame, descriptors: DataFrame, today: dt.date, start: dt.date, end: dt.date, visible: Sequence[str] | None = None, sources: Sequence[str] = (), models: Sequence[str] = (), device_ids: Sequence[str] = (), tz: str = "UTC") -> dict[str, DataFrame]:
    """Totals, sources, devices, models, days, activity and the models to choose from, by name.

    The activity range is fixed and ignores the chosen days; the list of models ignores the
    chosen models. Each part reads ``usage``: hand over a written table (``session.staged``) if
    all are asked for.
    """
    scoped = P.visible_scope(usage, "source_id", visible, sources)
    base = P.filter_usage(scoped, models=models, devices=device_ids, start=start, end=end, tz=tz)
    first, last = today - dt.timedelta(days=P.ACTIVITY_DAYS - 1), today
    return {
        "totals": A.grand_total(base),
        "sources": descriptor_join(A.source_totals(base), descriptors),
        "devices": A.device_breakdown(base, devices),
        "models": A.model_breakdown(base),
        "daily": A.daily_summary(base, tz),
        "activity": A.activity_heatmap(P.filter_usage(scoped, models=models, devices=device_ids, start=first, end=last, tz=tz), F.lit(today), tz),
        "available_models": P.filter_usage(scoped, devices=device_ids, start=start, end=end, tz=tz).select("model_family").distinct().orderBy("model_family"),
    }


def insights(usage: DataFrame, events: DataFrame, descriptors: DataFrame, start: dt.date, end: dt.date, sources: Sequence[str] = (), tz: str = "UTC") -> dict[str, DataFrame]:
    """Totals of a range and the one before, days, projects (local events), models, sources and active days, by name."""
    base = P.filter_usage(usage, sources=sources, start=start, end=end, tz=tz)
    local = P.filter_usage(events, sources=sources, start=start, end=end)
    return {
        "totals": A.grand_total(base),
        "comparison": A.period_comparison(P.filter_usage(usage, sources=sources, tz=tz), F.lit(start), F.lit(end), tz),
        "daily": A.daily_summary(base, tz),
        "projects": A.project_breakdown(local),
        "models": A.model_breakdown(base),
        "sources": descriptor_join(A.source_totals(base), descriptors),
        "active_days": A.active_days(base, tz),
    }
