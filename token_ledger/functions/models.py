"""Model names: family, spelling and price look-up candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A trailing plausible calendar date; families with a version in their name.
DATE_SUFFIX = r"-20[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$"
VERSIONED = "claude-(?:haiku|opus|sonnet)-"
#: Family -> the name it is priced under, with the time from which it holds and ends (seconds, null: open).
KIMI_CUTOVER = 1776698890.072
ALIASES = (
    ("gemini-3-pro-high", "gemini-3-pro-preview", None, None),
    ("k2p6", "kimi-k2.6", None, None),
    ("kimi-for-coding", "kimi-k2.5", None, KIMI_CUTOVER),
    ("kimi-for-coding", "kimi-k2.6", KIMI_CUTOVER, None),
)


def bare_model(model: Column) -> Column:
    """What stands after the last slash."""
    parts = F.array_remove(F.split(model, "/"), "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(model)


def model_family(model: Column) -> Column:
    return F.regexp_replace(model, DATE_SUFFIX, "")


def normalize_claude_version(model: Column) -> Column:
    """``x-4.5`` and ``x-45`` become ``x-4-5`` in the versioned families."""
    dotted = F.regexp_replace(model, rf"^({VERSIONED})([0-9]*)\.([0-9].*)$", "$1$2-$3")
    packed = F.regexp_replace(model, rf"^({VERSIONED})([0-9])([0-9].*)$", "$1$2-$3")
    return F.when(dotted != model, dotted).otherwise(packed)


def aliases_frame(spark, cutover: float = KIMI_CUTOVER):
    """The alias table ``family, alias, valid_from, valid_to``; ``cutover`` moves the dated alias."""
    rows = [(f, a, *(cutover if v == KIMI_CUTOVER else v for v in (lo, hi))) for f, a, lo, hi in ALIASES]
    frame = spark.createDataFrame(rows, "family string, alias string, lo double, hi double")
    return frame.select("family", "alias", *(F.timestamp_micros((F.round(F.col(c) * 1000) * 1000).cast("bigint")).alias(n) for c, n in (("lo", "valid_from"), ("hi", "valid_to"))))


def dated_alias(family: Column, ts: Column, cutover: float = KIMI_CUTOVER) -> Column:
    """The name that a family is priced under at a time; null if it has no other."""
    dated = F.when(F.coalesce(ts < F.timestamp_micros(F.lit(round(cutover * 1000) * 1000)), F.lit(False)), F.lit("kimi-k2.5")).otherwise("kimi-k2.6")
    return F.when(family == "gemini-3-pro-high", F.lit("gemini-3-pro-preview")).when(family == "k2p6", F.lit("kimi-k2.6")).when(family == "kimi-for-coding", dated)


def pricing_candidates(model: Column, ts: Column, cutover: float = KIMI_CUTOVER) -> Column:
    """Names to look a price up under, in order."""
    family = model_family(bare_model(model))
    return F.array_distinct(F.array_compact(F.array(family, normalize_claude_version(family), dated_alias(family, ts, cutover))))


#: Fixed values: (first letters or part of a model's name, provider it belongs to).
PROVIDER_PREFIXES = (("claude", "anthropic"), ("gpt", "openai"), ("o1", "openai"), ("o3", "openai"), ("o4", "openai"), ("gemini", "google"), ("deepseek", "deepseek"), ("qwen", "qwen"), ("kimi", "moonshot"), ("grok", "xai"), ("glm", "zai"), ("minimax", "minimax"))


def infer_provider(model: Column) -> Column:
    """The provider that a model's first letters tell; null if none does."""
    name = F.lower(bare_model(model))
    out = F.lit(None).cast("string")
    for prefix, provider in reversed(PROVIDER_PREFIXES):
        out = F.when(name.startswith(prefix), F.lit(provider)).otherwise(out)
    return out


def provider_candidates(model: Column, provider: Column | None = None) -> Column:
    """The model as written, and with its provider before it. Look-ups drop what stands before the last slash, so these meet in one candidate."""
    told = infer_provider(model) if provider is None else F.coalesce(F.nullif(F.lower(F.trim(provider)), F.lit("")), infer_provider(model))
    return F.array_distinct(F.array_compact(F.array(model, F.concat(told, F.lit("/"), bare_model(model)), bare_model(model))))
