"""Scans of agents that keep a session in one document, or in exported tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import paths as P
from ..operators import lookups as L
from ..schema import MONEY
from .events import usage_rows
from .lines import as_documents, as_lines

#: Names of columns: the parsed record and its file.
V, PATH = "v", "file_path"


def scan_amp(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Thread documents: ledger events with their messages' cache counts, else assistant messages."""
    docs = J.parsed(as_documents(spark, path)).select("file_path", J.text(V, "id").alias("thread"), J.items(V, "messages").alias("messages"), J.items(V, "usageLedger.events").alias("events")).filter("thread IS NOT NULL")
    messages = docs.select("file_path", "thread", F.posexplode("messages").alias("position", "v"), F.col("events").isNull().alias("no_ledger")).filter((J.text(V, "role") == "assistant") & J.has(V, "usage"))
    cache = messages.select("file_path", J.integer(V, "messageId").alias("message_id"), "position", J.count(V, "usage.cacheCreationInputTokens").alias("cache_create"), J.count(V, "usage.cacheReadInputTokens").alias("cache_read")).filter("message_id IS NOT NULL")
    ledger = docs.select("file_path", "thread", F.posexplode("events").alias("position", "v")).withColumn("message_id", J.integer(V, "toMessageId"))
    ledger = L.ledger_cache_join(ledger, cache).filter(J.text(V, "model").isNotNull() & J.has(V, "tokens"))
    own = lambda kind, k: F.concat_ws(":", F.lit("amp"), F.lit(kind), "thread", F.coalesce(J.text(V, k), F.col("position").cast("string")))
    one = usage_rows(
        ledger,
        "amp",
        {"input": J.count(V, "tokens.input"), "output": J.count(V, "tokens.output"), "cache_create": F.col("cache_create"), "cache_read": F.col("cache_read")},
        {"dedup_key": own("ledger", "id"), "timestamp_utc": J.time(V, "timestamp"), "session_id": F.col("thread"), "project_or_workspace": F.lit("Amp"), "request_id": J.text(V, "id"), "model_raw": J.text(V, "model"), "reported_cost": J.money(V, "credits")},
        total=J.integer(V, "tokens.total"),
    )
    two = usage_rows(
        messages.filter("no_ledger").filter(J.text(V, "usage.model", "model").isNotNull()),
        "amp",
        {"input": J.count(V, "usage.inputTokens"), "output": J.count(V, "usage.outputTokens"), "cache_create": J.count(V, "usage.cacheCreationInputTokens"), "cache_read": J.count(V, "usage.cacheReadInputTokens")},
        {"dedup_key": own("message", "messageId"), "timestamp_utc": J.time(V, "usage.timestamp", "timestamp"), "session_id": F.col("thread"), "project_or_workspace": F.lit("Amp"), "request_id": J.text(V, "messageId"), "model_raw": J.text(V, "usage.model", "model")},
        total=J.integer(V, "usage.totalTokens"),
    )
    return one.unionByName(two)


def droid_model(name: Column) -> Column:
    """Without brackets and the custom prefix, lower-case, dots and blanks as single dashes."""
    plain = F.regexp_replace(F.regexp_replace(name, "^custom:", ""), r"\[[^\]]*\]?|\]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(plain), "[. ]", "-"), "-+", "-"), "^-|-$", "")


#: Spellings of a provider, and the model name that stands for an unknown one of it.
DROID_PROVIDERS = (("anthropic", ("claude", "anthropic"), "claude-unknown"), ("openai", ("openai",), "gpt-unknown"), ("google", ("google", "google_ai", "gemini", "vertex", "vertex_ai"), "gemini-unknown"), ("xai", ("xai", "x_ai", "grok"), "grok-unknown"))


def scan_droid(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One settings document is one session; the model may stand in the chat file beside it."""
    docs = J.parsed(as_documents(spark, path, "*.settings.json")).withColumn("session", F.regexp_replace(P.name(PATH), r"\.settings\.json$", ""))
    docs = docs.withColumn("sidecar", F.concat(P.parent(PATH), F.lit("/"), F.col("session"), F.lit(".jsonl")))
    beside = as_lines(spark, path).filter(F.col("value").contains("Model:")).select(F.col(PATH).alias("sidecar"), "line", droid_model(F.regexp_extract("value", r'Model:["\\\[]*([^"\\\[]*)', 1)).alias("side_model"))
    docs = L.sidecar_join(docs, beside, "sidecar", "side_model")
    lock = F.replace(F.lower(J.text(V, "providerLock")), F.lit("-"), F.lit("_"))
    default = F.lit("unknown")
    for _, names, model in DROID_PROVIDERS:
        default = F.when(lock.isin(*names), F.lit(model)).otherwise(default)
    return usage_rows(
        docs.filter(J.has(V, "tokenUsage")),
        "droid",
        {"input": J.count(V, "tokenUsage.inputTokens"), "output": J.count(V, "tokenUsage.outputTokens"), "cache_create": J.count(V, "tokenUsage.cacheCreationTokens"), "cache_read": J.count(V, "tokenUsage.cacheReadTokens"), "reasoning": J.count(V, "tokenUsage.thinkingTokens")},
        {
            "dedup_key": F.concat(F.lit("droid:"), F.col("session")),
            "timestamp_utc": F.coalesce(J.time(V, "providerLockTimestamp"), F.col("modified_at")),
            "session_id": F.col("session"),
            "project_or_workspace": F.lit("Droid"),
            "request_id": F.concat(F.lit("droid:"), F.col("session")),
            "model_raw": droid_model(F.coalesce(J.text(V, "model"), "side_model", default)),
        },
        total=J.integer(V, "tokenUsage.totalTokens"),
    )


def _cache_tokens() -> dict[str, Column]:
    return {"input": J.count(V, "tokens.input"), "output": J.count(V, "tokens.output"), "cache_create": J.count(V, "tokens.cache.write"), "cache_read": J.count(V, "tokens.cache.read")}


def _opencode(rows: DataFrame) -> DataFrame:
    model = J.text(V, "modelID", "modelId", "model")
    created = J.integer(V, "time.created")
    message = F.coalesce("row_id", J.text(V, "id"))
    return usage_rows(
        rows.filter(J.has(V, "tokens") & model.isNotNull() & J.text(V, "providerID", "providerId").isNotNull()),
        "opencode",
        _cache_tokens(),
        {
            "dedup_key": F.concat(F.lit("opencode:"), F.coalesce(message, F.col(PATH))),
            "timestamp_utc": F.coalesce(F.timestamp_millis(created), F.timestamp_seconds(F.lit(0))),
            "session_id": F.coalesce("row_session", J.text(V, "sessionID", "sessionId"), P.stem(PATH)),
            "project_or_workspace": F.lit("OpenCode"),
            "request_id": message,
            "model_raw": model,
            "reported_cost": J.money(V, "cost"),
        },
        total=J.integer(V, "tokens.total"),
    )


def read_opencode_files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One message for each JSON file under ``/storage/message/``."""
    docs = J.parsed(as_documents(spark, path).filter(F.col(PATH).contains("/storage/message/")))
    return _opencode(docs.withColumns({"row_id": F.lit(None).cast("string"), "row_session": F.lit(None).cast("string")}))


def scan_message_table(rows: DataFrame, agent: str) -> DataFrame:
    """Usage of an exported message table ``rowid, id, session_id, data``: ``opencode`` or ``kilo``."""
    table = J.parsed(rows, "data").withColumns({"row_id": F.col("id").cast("string"), "row_session": F.col("session_id").cast("string"), "file_path": F.col("file_path") if "file_path" in rows.columns else F.lit(agent)})
    if agent == "opencode":
        return _opencode(table)
    if agent != "kilo":
        raise ValueError(f"no message table is known for {agent}")
    created = J.integer(V, "time.created")
    session, message = F.coalesce(J.text(V, "sessionID", "sessionId"), "row_session"), F.coalesce(J.text(V, "id"), "row_id")
    model = J.text(V, "modelID", "modelId", "model")
    return usage_rows(
        table.filter((J.text(V, "role") == "assistant") & J.has(V, "tokens") & model.isNotNull()),
        "kilo",
        _cache_tokens() | {"reasoning": J.count(V, "tokens.reasoning")},
        {
            "dedup_key": F.concat_ws(":", F.lit("kilo"), session, message),
            "timestamp_utc": F.when(created > 0, J.epoch_time(created.cast("double"), 1e12 - 1)),
            "session_id": session,
            "project_or_workspace": F.lit("Kilo"),
            "request_id": message,
            "model_raw": model,
            "reported_cost": J.money(V, "cost"),
        },
        total=J.integer(V, "tokens.total"),
    )


def _first_column(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    """First non-null of the columns that the table has; text is trimmed and not empty."""
    have = [n for n in names if n in df.columns]
    if not have:
        return F.lit(None).cast(kind)
    if kind == "string":
        return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in have))
    return F.coalesce(*(F.col(n).cast("string").try_cast(kind) if kind != "bigint" else F.coalesce(F.col(n).cast("string").try_cast("bigint"), F.col(n).cast("string").try_cast("double").try_cast("bigint")) for n in have))


def _table_time(df: DataFrame, *names: str) -> Column:
    have = [n for n in names if n in df.columns]
    kinds = dict(df.dtypes)
    each = [F.col(n).cast("timestamp") if kinds[n].startswith(("timestamp", "date")) else F.coalesce(J.plain_time(F.trim(F.col(n).cast("string"))), J.epoch_time(F.col(n).cast("string").try_cast("double"))) for n in have]
    return F.coalesce(*each) if each else F.lit(None).cast("timestamp")


def scan_session_table(rows: DataFrame, agent: str) -> DataFrame:
    """Usage of an exported table of cumulative sessions: ``goose`` or ``hermes``. Columns may be missing."""
    whole = lambda *names: _first_column(rows, names, "bigint")
    word = lambda *names: _first_column(rows, names, "string")
    zero = F.lit(0).cast("bigint")
    session = word("id", "session_id", "sessionId")
    table = rows if "file_path" in rows.columns else rows.withColumn("file_path", F.lit(agent))
    if agent == "goose":
        config = J.parse(word("model_config_json", "modelConfigJson"))
        i = F.coalesce(whole("accumulated_input_tokens", "input_token_count", "input_tokens", "inputTokens"), zero)
        o = F.coalesce(whole("accumulated_output_tokens", "output_token_count", "output_tokens", "outputTokens"), zero)
        total = F.coalesce(whole("accumulated_total_tokens", "total_token_count", "total_tokens", "totalTokens"), zero)
        tokens = {"input": i, "output": o, "reasoning": F.greatest(zero, total - i - o)}
        columns = {"timestamp_utc": _table_time(rows, "created_at", "createdAt"), "project_or_workspace": F.lit("Goose"), "model_raw": F.coalesce(word("model", "model_name", "modelName"), J.text(config, "model_name", "modelName", "model"), F.lit("unknown"))}
    elif agent == "hermes":
        total = zero
        tokens = {"input": whole("input_tokens", "inputTokens"), "output": whole("output_tokens", "outputTokens"), "cache_create": whole("cache_creation_tokens", "cacheCreationTokens"), "cache_read": whole("cache_read_tokens", "cacheReadTokens"), "reasoning": whole("reasoning_tokens", "reasoningTokens")}
        model = word("model", "model_id", "modelId")
        table = table.filter(model.isNotNull())
        columns = {"timestamp_utc": _table_time(rows, "started_at", "startedAt", "created_at", "createdAt"), "project_or_workspace": F.lit("Hermes Agent"), "model_raw": model, "reported_cost": _first_column(rows, ("actual_cost", "estimated_cost"), MONEY)}
    else:
        raise ValueError(f"no session table is known for {agent}")
    return usage_rows(table.filter(session.isNotNull()), agent, tokens, {"dedup_key": F.concat(F.lit(f"{agent}:"), session), "session_id": session, "request_id": session, **columns}, total=total, keep_costed=agent == "hermes")
