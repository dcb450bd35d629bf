"""Prices: attach, compute, flag, re-price, build and check the price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import tokens as K
from ..schema import MONEY, RATE

RATES = ("input_rate", "output_rate", "cache_write_rate", "cache_read_rate")
#: The agent that counts reasoning inside output; others bill it at the output rate.
REASONING_IN_OUTPUT = "codex-cli"
FLAG_UNPRICED_ONLY = "claude-code"


#: Most prices that are broadcast; public lists have a few hundred.
MOST_BROADCAST = 50_000


def attach_price(events: DataFrame, prices: DataFrame, cutover: float = M.KIMI_CUTOVER, candidates: Column | None = None) -> DataFrame:
    """``events`` with the rates of the first candidate that has a price; null if none has.

    A price is found under the exact name or its lower-case form. The price table is counted;
    up to ``MOST_BROADCAST`` rows it goes to the events, which are neither shuffled nor read
    twice. Beyond it, and for ``candidates`` of the caller's, distinct candidate lists are
    resolved once (models are few, events many) and joined back.
    """
    if candidates is None and prices.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return _attach_broadcast(events, prices, cutover)
    return _attach_resolved(events, prices, M.pricing_candidates(F.col("model_raw"), F.col("timestamp_utc"), cutover) if candidates is None else candidates)


def _attach_broadcast(events: DataFrame, prices: DataFrame, cutover: float) -> DataFrame:
    """One look-up for each of the three names that ``pricing_candidates`` lists."""
    rate = F.struct(*RATES)
    lookup = prices.groupBy(F.lower("family").alias("_low")).agg(F.min_by(rate, "family").alias("_low_rate"), F.collect_list(F.struct("family", rate.alias("rate"))).alias("_exact"))
    out = events.withColumn("_name0", M.model_family(M.bare_model(F.col("model_raw"))))
    out = out.withColumns({"_name1": M.normalize_claude_version(F.col("_name0")), "_name2": M.dated_alias(F.col("_name0"), F.col("timestamp_utc"), cutover)})
    found = []

    def exact(rows: str, name: str) -> Column:
        return F.get(F.filter(rows, lambda x: x["family"] == F.col(name)), F.lit(0))["rate"]

    for n in range(3):
        side = F.broadcast(lookup.select(*(F.col(c).alias(f"{c}{n}") for c in lookup.columns)))
        out = out.join(side, F.lower(f"_name{n}") == F.col(f"_low{n}"), "left")
        found.append(F.coalesce(exact(f"_exact{n}", f"_name{n}"), F.col(f"_low_rate{n}")))
    return out.select(*(F.col(f"`{c}`") for c in events.columns), F.coalesce(*found).alias("_rate")).select(*(F.col(f"`{c}`") for c in events.columns), "_rate.*")


def _attach_resolved(events: DataFrame, prices: DataFrame, names: Column) -> DataFrame:
    keyed = events.withColumn("_candidates", names)
    each = keyed.select("_candidates").distinct().select("_candidates", F.posexplode("_candidates").alias("_pos", "_name"))
    exact = prices.select(F.col("family").alias("_name"), F.struct(*RATES).alias("_rate"))
    lower = prices.groupBy(F.lower("family").alias("_low")).agg(F.min_by(F.struct(*RATES), "family").alias("_low_rate"))
    found = each.join(exact, "_name", "left").join(lower, F.lower("_name") == F.col("_low"), "left")
    found = found.withColumn("_rate", F.coalesce("_rate", "_low_rate")).filter(F.col("_rate").isNotNull())
    best = found.groupBy("_candidates").agg(F.min_by("_rate", "_pos").alias("_rate")).select("_candidates", "_rate.*")
    return keyed.join(best, "_candidates", "left").drop("_candidates")


def compute_cost() -> Column:
    """Exact cost of a row with rates; null without a price. Cache rates fall back to the input rate."""

    def part(tokens: str | Column, rate: Column) -> Column:
        tokens = F.col(tokens) if isinstance(tokens, str) else tokens
        return tokens.cast("decimal(15,0)") * rate

    output = F.when(F.col("source_id") == REASONING_IN_OUTPUT, F.col("output_tokens")).otherwise(F.col("output_tokens") + F.col("reasoning_tokens"))
    return (
        part("input_tokens", F.col("input_rate"))
        + part(output, F.col("output_rate"))
        + part("cache_read_tokens", F.coalesce("cache_read_rate", "input_rate"))
        + part("cache_create_tokens", F.coalesce("cache_write_rate", "input_rate"))
    ).cast(MONEY)


def cost_and_flag(df: DataFrame, reported: str = "reported_cost", fallback: str | None = None) -> DataFrame:
    """``df`` (with rates) with cost_usd and cost_is_estimated.

    A reported cost wins. Without one: an agent that prices exactly is estimated only if
    unpriced, the counter-based one if unpriced or its model is a fallback, the rest always.
    """
    priced = F.col("input_rate").isNotNull()
    guessed = F.coalesce(F.col(fallback), F.lit(False)) if fallback else F.lit(False)
    flag = (
        F.when(F.col("source_id") == REASONING_IN_OUTPUT, guessed | ~priced)
        .when(F.col(reported).isNotNull(), False)
        .when(F.col("source_id") == FLAG_UNPRICED_ONLY, ~priced)
        .otherwise(True)
    )
    cost = F.coalesce(F.col(reported).cast(MONEY), compute_cost(), F.lit(0).cast(MONEY))
    return df.withColumn("cost_usd", cost).withColumn("cost_is_estimated", flag)


def reprice(events: DataFrame, prices: DataFrame, cutover: float = M.KIMI_CUTOVER) -> DataFrame:
    """``events`` with estimated rows re-priced, and ``changed``.

    Only estimated rows whose model has a price now take the new cost. A row that had no cost
    is confirmed by it; one that had stays estimated.
    """
    priced = attach_price(events, prices, cutover)
    due = F.col("cost_is_estimated") & F.col("input_rate").isNotNull()
    cost = F.when(due, compute_cost()).otherwise(F.col("cost_usd"))
    flag = F.when(due & (F.col("cost_usd") == 0), False).otherwise(F.col("cost_is_estimated"))
    out = priced.withColumns({"_cost": cost, "_flag": flag})
    changed = ~(F.col("_cost").eqNullSafe(F.col("cost_usd")) & F.col("_flag").eqNullSafe(F.col("cost_is_estimated")))
    return out.withColumn("changed", changed).withColumns({"cost_usd": F.col("_cost"), "cost_is_estimated": F.col("_flag")}).drop("_cost", "_flag", *RATES)


def temporal_alias_join(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """``events`` with the alias of their family that holds at their time; null if none does.

    The alias table is the fixed dimension of ``models.aliases_frame`` (a few rows).
    """
    a = F.broadcast(aliases.withColumnRenamed("family", "_family"))
    holds = (F.col("valid_from").isNull() | (F.col("timestamp_utc") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("timestamp_utc") < F.col("valid_to")))
    return events.join(a, (F.col("model_family") == F.col("_family")) & holds, "left").drop("_family", "valid_from", "valid_to")


#: Provider -> condition on the bare lower-case key (or the whole key) for the price list.
def relevant_price_key(key: Column, provider: Column) -> Column:
    """Whether an entry of a public price list is kept."""
    whole = F.lower(key)
    bare = F.element_at(F.split(whole, "/"), -1)
    starts = lambda *names: F.rlike(bare, F.lit("^(" + "|".join(names) + ")"))
    return (
        ((provider == "anthropic") & whole.contains("claude"))
        | ((provider == "openai") & (starts("gpt-5", "gpt-4", "o1", "o3", "o4") | bare.contains("codex")))
        | ((provider == "gemini") & starts("gemini"))
        | ((provider == "vertex_ai-language-models") & starts("gemini") & ~bare.contains("embedding"))
        | ((provider == "dashscope") & bare.contains("qwen"))
        | ((provider == "openrouter") & whole.contains("/qwen/"))
        | ((provider == "moonshot") & bare.contains("kimi"))
        | provider.isin("github_copilot", "deepseek")
        | ((provider == "xai") & bare.contains("grok"))
        | (provider.isin("zai", "zhipu", "zhipuai") & bare.contains("glm"))
        | ((provider == "minimax") & bare.contains("minimax"))
    )


#: Family that a price list lacks -> the family whose price it takes.
FAMILY_ALIASES = {"kimi-k2": "kimi-k2-0905-preview"}


def build_price_table(raw: DataFrame) -> DataFrame:
    """Price table from ``position, key, provider, input_cost, output_cost, cache_write_cost, cache_read_cost`` (a token).

    One row for each family: the last key without a provider before it, else the first with
    one. Rates a million are rounded to 6 digits, as published tables have them.
    """
    kept = raw.filter(relevant_price_key(F.col("key"), F.coalesce("provider", F.lit("")))).filter("input_cost IS NOT NULL AND output_cost IS NOT NULL")
    bare = F.element_at(F.split("key", "/"), -1)
    qualified = F.col("key").contains("/")
    order = Window.partitionBy("family").orderBy(qualified, F.when(qualified, F.col("position")).otherwise(-F.col("position")))
    million = lambda c: F.round(F.col(c) * 1000000, 6).cast("decimal(14,6)")
    one = (
        kept.withColumn("family", F.regexp_replace(bare, "-[0-9]{8}$", ""))
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .select("family", million("input_cost").alias("input_per_million"), million("output_cost").alias("output_per_million"), million("cache_write_cost").alias("cache_write_per_million"), million("cache_read_cost").alias("cache_read_per_million"))
    )
    names = F.create_map(*(F.lit(x) for alias, family in FAMILY_ALIASES.items() for x in (family, alias)))
    extra = one.withColumn("family", names[F.col("family")]).filter("family IS NOT NULL").join(one.select("family"), "family", "left_anti")
    return one.unionByName(extra.select(one.columns))


def per_token(per_million: Column) -> Column:
    """A rate for one token, exactly."""
    return (per_million.cast("decimal(14,6)") * F.lit("0.000001").cast("decimal(7,6)")).cast(RATE)


#: What a complete price table must hold.
LEAST_FAMILIES = 100
REQUIRED_PREFIXES = ("gpt-", "claude-", "grok-", "gemini-", "deepseek-", "glm-", "kimi-", "minimax-")


def validate_price_table(prices: DataFrame, least: int = LEAST_FAMILIES, prefixes: tuple[str, ...] = REQUIRED_PREFIXES) -> DataFrame:
    """One row ``families, missing_prefixes, complete``."""
    has = [F.coalesce(F.bool_or(F.lower("family").startswith(p)), F.lit(False)).alias(f"_p{i}") for i, p in enumerate(prefixes)]
    counted = prices.agg(F.count(F.lit(1)).alias("families"), *has)
    missing = sum((F.when(F.col(f"_p{i}"), 0).otherwise(1) for i in range(len(prefixes))), F.lit(0)).cast("bigint")
    return counted.select("families", missing.alias("missing_prefixes"), ((F.col("families") >= least) & (missing == 0)).alias("complete"))


def override_merge(base: DataFrame, local: DataFrame, key: str = "family") -> DataFrame:
    """Rows of both, ``local`` winning for each key."""
    cols = [c for c in base.columns if c != key]
    b = base.select(key, F.struct(*cols).alias("_b"))
    a = local.select(key, F.struct(*cols).alias("_a"))
    return b.join(a, key, "full").select(key, F.coalesce("_a", "_b").alias("_r")).select(key, "_r.*")
