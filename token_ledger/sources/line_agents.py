"""Scans of agents that write one JSON record a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import paths as P
from ..functions.models import model_family
from ..operators import counters as C
from ..operators import traces as T
from ..session import staged
from .events import usage_rows
from .lines import as_documents, as_lines, prefer_live_over_archived

#: Names of columns: the parsed record and its file.
V, PATH = "v", "file_path"


def _line() -> Column:
    """Line number from 1."""
    return F.col("line") + 1


def _key(source_id: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(source_id), *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


def scan_claude(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Assistant messages with usage. The key is the message id, else path and line from 0."""
    lines = J.parsed(as_lines(spark, path).filter(F.col("value").contains('"usage"')))
    u = "message.usage"
    split = J.has(V, f"{u}.cache_creation")
    create = F.when(split, J.count(V, f"{u}.cache_creation.ephemeral_5m_input_tokens") + J.count(V, f"{u}.cache_creation.ephemeral_1h_input_tokens")).otherwise(J.count(V, f"{u}.cache_creation_input_tokens"))
    words = {"version": "version", "session": "sessionId", "request": "requestId", "message": "message.id", "model": "message.model", "stamp": "timestamp"}
    lines = J.taken(
        lines,
        input=J.integer(V, f"{u}.input_tokens"),
        output=J.integer(V, f"{u}.output_tokens"),
        cache_create=create,
        cache_read=J.count(V, f"{u}.cache_read_input_tokens"),
        sidechain=J.flag(V, "isSidechain"),
        cost=J.money(V, "costUSD"),
        **{n: J.raw_text(V, p) for n, p in words.items()},
    )
    ok = F.col("input").isNotNull() & F.col("output").isNotNull() & (F.coalesce("version", F.lit("")).rlike(r"^$|^\d+\.\d+\.\d+"))
    for c in ("session", "request", "message", "model"):
        ok = ok & F.coalesce(F.col(c) != "", F.lit(True))
    model, rest = J.filled("model"), F.col("rest")  # of the path
    nested = (F.size(rest) >= 4) & (F.element_at(rest, -2) == "subagents")
    front = lambda drop: F.coalesce(F.nullif(F.array_join(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - drop, F.lit(0))), "/"), F.lit("")), F.lit("Unknown Project"))
    project = F.when(rest.isNull(), None).when(F.size(rest) <= 1, "Unknown Project").when(F.size(rest) == 2, rest[0]).when(nested, front(3)).otherwise(front(2))
    session = F.when(rest.isNull() | (F.size(rest) == 2), P.stem(PATH)).when(nested, F.element_at(rest, -3)).when(F.size(rest) >= 2, F.element_at(rest, -2)).otherwise("unknown")
    message = J.filled("message")
    rows = lines.filter(ok & model.isNotNull() & (model != "<synthetic>")).withColumn("rest", P.after(PATH, "projects"))
    return usage_rows(
        rows,
        "claude-code",
        {t: F.col(t) for t in ("input", "output", "cache_create", "cache_read")},
        {
            "dedup_key": F.when(message.isNotNull(), F.concat(F.lit("claude-message:"), message)).otherwise(_key("claude-line", PATH, F.col("line"))),
            "is_sidechain_replay": F.col("sidechain"),
            "timestamp_utc": J.iso_time(J.filled("stamp")),
            "session_id": F.coalesce(J.filled("session"), session),
            "project_or_workspace": project,
            "request_id": J.filled("request"),
            "model_raw": model,
            "reported_cost": F.col("cost"),
            "source_file_line": _line(),
        },
    )


def _object(*paths: str) -> Column:
    """The first of several paths that holds an object, as a variant."""
    found = (F.try_variant_get(V, J.path(*p.split(".")), "variant") for p in paths)
    return F.coalesce(*(F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in found))


def _counters(v: str) -> Column:
    """Counter struct of an object; null without one."""
    at = lambda *keys: J.integer(v, *keys)
    zero = F.lit(0).cast("bigint")
    part = lambda *keys: F.coalesce(at(*keys), zero)
    i, o, r = part("input_tokens", "prompt_tokens", "input"), part("output_tokens", "completion_tokens", "output"), part("reasoning_output_tokens", "reasoning_tokens")
    told = at("total_tokens")
    total = F.coalesce(F.when((told > 0) | (i + o + r == 0), told), i + o + r)
    return F.when(F.col(v).isNotNull(), F.struct(i.alias("input"), part("cached_input_tokens", "cache_read_input_tokens", "cached_tokens").alias("cached"), o.alias("output"), r.alias("reasoning"), total.alias("total")))


def _model_at(*bases: str) -> Column:
    prefix = [f"{b}." if b else "" for b in bases]
    return J.text(V, *(f"{p}{k}" for p in prefix for k in ("model", "model_name", "metadata.model")))


HEADLESS = ("", "data", "result", "response")


def scan_codex(spark: SparkSession, path: str | DataFrame, block: int | None = None) -> DataFrame:
    """Token counters (cumulative or per call) and headless usage records.

    In order: repeats are dropped and deltas taken, then models resolved, then what a forked
    session repeats of its parent goes, then rows without tokens. Lines are parsed when this
    is called, and what was read stands in the shared folder. ``block``: lines of a file that
    one task takes at once, for files too long for one task.
    """
    lines = as_lines(spark, path)
    live = prefer_live_over_archived(lines.select("file_path").distinct())
    lines = J.parsed(lines.join(live, "file_path"))
    kind, inner = J.text(V, "type"), J.text(V, "payload.type")
    is_counter, is_context = (kind == "event_msg") & (inner == "token_count"), kind == "turn_context"
    stamp = J.text(V, "timestamp")
    rows = lines.select(
        "file_path",
        "line",
        "home",
        F.coalesce(is_counter, F.lit(False)).alias("is_counter"),
        F.coalesce(is_context, F.lit(False)).alias("is_context"),
        F.coalesce(stamp, J.text(V, *(f"{b}.{k}" if b else k for b in HEADLESS for k in ("timestamp", "created_at", "createdAt")))).alias("stamp"),
        F.when(is_counter, _object("payload.info.total_token_usage")).alias("total"),
        F.when(is_counter, _object("payload.info.last_token_usage")).alias("last"),
        F.when(~F.coalesce(is_counter | is_context, F.lit(False)), _object(*(f"{b}.usage" if b else "usage" for b in HEADLESS))).alias("headless"),
        F.when(is_context | is_counter, _model_at("payload", "payload.info")).otherwise(_model_at(*HEADLESS)).alias("model"),
        F.when(kind == "session_meta", J.text(V, "payload.id")).alias("meta_id"),
        F.when(kind == "session_meta", J.text(V, "payload.forked_from_id")).alias("parent_id"),
    )
    # The window is over these few columns, with nothing of the JSON itself.
    rows = rows.withColumns({c: _counters(c) for c in ("total", "last", "headless")})
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("line")) == 1
    rows = rows.withColumn("parent_id", F.when(first, F.col("parent_id"))).filter("is_counter OR is_context OR headless IS NOT NULL OR meta_id IS NOT NULL")
    rows = staged(rows, "codex-rows")  # six branches read them

    # What a child session repeats of its parent: judged on every counter row with a snapshot.
    own_id = F.lower(F.regexp_extract("file_path", r"([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})\.jsonl$", 1))
    shots = rows.filter("is_counter AND (total IS NOT NULL OR last IS NOT NULL)").select("file_path", "line", "home", own_id.alias("session_id"), J.iso_time(F.col("stamp")).alias("at"), F.struct(F.coalesce(F.to_json("total"), F.lit("")), F.coalesce(F.to_json("last"), F.lit(""))).alias("snapshot"))
    forks = rows.filter("parent_id IS NOT NULL").select("file_path", "home", F.lower("parent_id").alias("parent_id"), J.iso_time(F.col("stamp")).alias("fork_at")).filter("fork_at IS NOT NULL")
    fresh = C.drop_fork_replay(shots, forks).select("file_path", "line")
    replayed = shots.select("file_path", "line").join(fresh, ["file_path", "line"], "left_anti")

    # A repeat leaves the last total as it is, so one scan serves both.
    counted = C.previous_total(rows.filter("is_counter AND stamp IS NOT NULL"), block=block).filter("NOT coalesce(total = _previous, false)").withColumn("usage", C.usage_of())
    usage = counted.filter("usage IS NOT NULL").select("file_path", "line", "stamp", "model", "usage").unionByName(rows.filter("headless IS NOT NULL").select("file_path", "line", "stamp", "model", F.col("headless").alias("usage")))
    stated = rows.filter("is_context AND model IS NOT NULL").select("file_path", "line", "stamp", "model", F.lit(None).cast(usage.schema["usage"].dataType).alias("usage"))
    ordered = usage.withColumn("is_usage", F.lit(True)).unionByName(stated.withColumn("is_usage", F.lit(False)))
    resolved = C.resolve_fallback_model(ordered.withColumn("event_date", F.substring("stamp", 1, 10)), block=block).filter("is_usage")
    kept = resolved.join(replayed, ["file_path", "line"], "left_anti")

    u = lambda f: F.col(f"usage.{f}")
    cached = F.least(u("cached"), u("input"))
    rest = F.coalesce(P.after(PATH, "sessions", "archived_sessions", last=True), F.array(P.name(PATH)))
    session = F.regexp_replace(F.array_join(rest, "/"), r"\.jsonl$", "")
    return usage_rows(
        kept,
        "codex-cli",
        {"input": F.greatest(F.lit(0).cast("bigint"), u("input") - cached), "output": u("output"), "cache_read": cached, "reasoning": u("reasoning")},
        {
            "dedup_key": _key("codex-token", F.col("stamp"), model_family(F.col("resolved_model")), *(u(f) for f in C.COUNTER_FIELDS)),
            "timestamp_utc": J.iso_time(F.col("stamp")),
            "session_id": session,
            "project_or_workspace": F.nullif(F.array_join(F.slice(rest, F.lit(1), F.size(rest) - 1), "/"), F.lit("")),
            "model_raw": F.col("resolved_model"),
            "is_fallback_model": F.col("is_fallback"),
            "source_file_line": _line(),
        },
    )


def _folder_project(path: Column) -> Column:
    """The name of the folder that holds the file's folder of chats, else of the file."""
    return F.element_at(P.parts(path), -2)


def scan_gemini(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Chat records a line, or arrays of them in documents; the last header's session and project hold for later lines."""
    session = J.text(V, "sessionId", "session_id")
    head = J.parsed(as_lines(spark, path)).withColumns({"session": session, "project": F.when(session.isNotNull(), J.text(V, "projectHash", "project", "project_path"))})
    lined = C.carry_forward(head, ["session", "project"]).select("file_path", "line", "v", "session", "project")
    docs = J.parsed(as_documents(spark, path))
    one = F.coalesce(J.items(V, "$"), F.array(F.col(V)))
    whole = docs.select("file_path", F.posexplode(one).alias("line", "v")).withColumns({"session": F.lit(None).cast("string"), "project": F.lit(None).cast("string")})
    rows = lined.unionByName(whole.withColumn("line", F.col("line").cast("bigint"))).filter(J.text(V, "type") == "gemini")
    cached = J.count(V, "tokens.cached")
    return usage_rows(
        rows.filter(J.has(V, "tokens")),
        "gemini-cli",
        {"input": F.greatest(F.lit(0).cast("bigint"), J.count(V, "tokens.input") - cached) + J.count(V, "tokens.tool"), "output": J.count(V, "tokens.output"), "cache_read": cached, "reasoning": J.count(V, "tokens.thoughts")},
        {
            "dedup_key": _key("gemini-cli", PATH, _line()),
            "timestamp_utc": J.time(V, "timestamp"),
            "session_id": F.coalesce("session", P.stem(PATH)),
            "project_or_workspace": F.coalesce("project", F.lit("Gemini CLI")),
            "request_id": J.text(V, "id"),
            "model_raw": F.coalesce(J.text(V, "model"), F.lit("gemini")),
            "source_file_line": _line(),
        },
        total=J.integer(V, "tokens.total"),
    )


def scan_qwen(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Assistant records with usage metadata in either spelling."""
    both = lambda a, b: [f"{u}.{k}" for u in ("usageMetadata", "usage_metadata") for k in (a, b)]
    rows = J.parsed(as_lines(spark, path)).filter((J.text(V, "type") == "assistant") & (J.has(V, "usageMetadata") | J.has(V, "usage_metadata")))
    project = F.coalesce(P.after(PATH, "projects")[0], F.lit("qwen"))
    return usage_rows(
        rows,
        "qwen",
        {
            "input": J.count(V, *both("promptTokenCount", "prompt_token_count")),
            "output": J.count(V, *both("candidatesTokenCount", "candidates_token_count")),
            "cache_read": J.count(V, *both("cachedContentTokenCount", "cached_content_token_count")),
            "reasoning": J.count(V, *both("thoughtsTokenCount", "thoughts_token_count")),
        },
        {
            "dedup_key": _key("qwen", PATH, _line()),
            "timestamp_utc": F.coalesce(J.time(V, "timestamp"), F.col("modified_at")),
            "session_id": F.coalesce(J.text(V, "sessionId", "session_id"), F.concat(project, F.lit("-"), P.stem(PATH))),
            "project_or_workspace": F.coalesce(P.after(PATH, "projects")[0], F.lit("Qwen")),
            "model_raw": F.coalesce(J.text(V, "model"), F.lit("unknown")),
            "source_file_line": _line(),
        },
        total=J.integer(V, *both("totalTokenCount", "total_token_count")),
    )


def scan_kimi(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Status updates; the model stands in the configuration four folders up."""
    config = as_documents(spark, path, "config.json").select(P.parent(PATH).alias("root"), J.text(J.parse(F.col("value")), "model").alias("model"))
    root = PATH
    for _ in range(4):
        root = P.parent(root)
    rows = J.parsed(as_lines(spark, path, "wire.jsonl")).filter((J.text(V, "message.type") == "StatusUpdate") & J.has(V, "message.payload.token_usage"))
    rows = rows.withColumn("root", root).join(config, "root", "left")
    u = "message.payload.token_usage"
    return usage_rows(
        rows,
        "kimi",
        {"input": J.count(V, f"{u}.input_other"), "output": J.count(V, f"{u}.output"), "cache_create": J.count(V, f"{u}.input_cache_creation"), "cache_read": J.count(V, f"{u}.input_cache_read")},
        {
            "dedup_key": _key("kimi", PATH, _line()),
            "timestamp_utc": J.time(V, "timestamp"),
            "session_id": P.name(P.parent(PATH)),
            "project_or_workspace": F.lit("Kimi"),
            "request_id": J.text(V, "message.payload.message_id"),
            "model_raw": F.coalesce("model", F.lit("kimi-for-coding")),
            "source_file_line": _line(),
        },
    )


def _message_tokens(base: str = "message.usage") -> dict[str, Column]:
    return {"input": J.count(V, f"{base}.input"), "output": J.count(V, f"{base}.output"), "cache_create": J.count(V, f"{base}.cacheWrite"), "cache_read": J.count(V, f"{base}.cacheRead")}


def _is_answer(strict: bool) -> Column:
    kind = J.text(V, "type")
    typed = (kind == "message") if strict else (kind.isNull() | (kind == "message"))
    return typed & (J.text(V, "message.role") == "assistant") & J.has(V, "message.usage")


def scan_pi(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    stem = P.stem(PATH)
    rows = J.parsed(as_lines(spark, path)).filter(_is_answer(False))
    return usage_rows(
        rows,
        "pi",
        _message_tokens(),
        {
            "dedup_key": _key("pi", PATH, _line()),
            "timestamp_utc": J.time(V, "timestamp"),
            "session_id": F.when(stem.rlike("^[^_]+_.+"), F.regexp_extract(stem, "^[^_]+_(.+)$", 1)).otherwise(stem),
            "project_or_workspace": F.coalesce(P.after(PATH, "sessions")[0], F.lit("unknown")),
            "model_raw": F.concat(F.lit("[pi] "), F.coalesce(J.text(V, "message.model"), F.lit("unknown"))),
            "reported_cost": J.money(V, "message.usage.cost.total"),
            "source_file_line": _line(),
        },
        total=J.integer(V, "message.usage.totalTokens"),
    )


def scan_omp(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """As ``scan_pi``, with reasoning; a session line names the session of later lines."""
    dated = r"^[^_]*T[^_]*_(.+)$"
    named = lambda s: F.when(s.rlike(dated) & (F.instr(s, "_") > 16), F.regexp_extract(s, dated, 1))
    lines = J.parsed(as_lines(spark, path)).withColumn("session", F.when(J.text(V, "type") == "session", J.text(V, "id")))
    rows = C.carry_forward(lines, ["session"]).filter(_is_answer(False))
    request = J.text(V, "id", "message.id")
    tokens = _message_tokens() | {"reasoning": J.count(V, "message.usage.reasoningTokens", "message.usage.reasoning")}
    return usage_rows(
        rows,
        "oh-my-pi",
        tokens,
        {
            "dedup_key": F.when(request.isNotNull(), _key("oh-my-pi", F.lit("msg"), request)).otherwise(_key("oh-my-pi", PATH, _line())),
            "timestamp_utc": J.time(V, "timestamp", "message.timestamp"),
            "session_id": F.coalesce("session", named(P.stem(PATH)), named(P.name(P.parent(PATH))), P.stem(PATH)),
            "project_or_workspace": F.coalesce(P.after(PATH, "sessions")[0], F.lit("unknown")),
            "request_id": request,
            "model_raw": F.concat(F.lit("[omp] "), F.coalesce(J.text(V, "message.model", "message.modelId"), F.lit("unknown"))),
            "reported_cost": J.money(V, "message.usage.cost.total"),
            "source_file_line": _line(),
        },
        total=J.integer(V, "message.usage.totalTokens"),
    )


def scan_openclaw(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Messages with usage, deleted and reset files too; the model is the last one that a line set."""
    keys = [f"{b}{k}" for b in ("data.", "") for k in ("modelId", "model", "modelID")]
    sets = (J.text(V, "type") == "model_change") | ((J.text(V, "type") == "custom") & (J.text(V, "customType") == "model-snapshot"))
    lines = J.parsed(as_lines(spark, path, "*.jsonl*").filter(F.col(PATH).rlike(r"\.jsonl($|\.deleted\.|\.reset\.)")))
    rows = C.carry_forward(lines.withColumn("set_model", F.when(sets, F.coalesce(J.text(V, *keys), F.lit("unknown")))), ["set_model"]).filter(_is_answer(True))
    return usage_rows(
        rows,
        "openclaw",
        _message_tokens(),
        {
            "dedup_key": _key("openclaw", PATH, _line()),
            "timestamp_utc": F.coalesce(J.time(V, "message.timestamp", "timestamp"), F.col("modified_at")),
            "session_id": F.coalesce(F.nullif(F.regexp_replace(P.name(PATH), r"\.jsonl.*$", ""), F.lit("")), P.name(PATH)),
            "project_or_workspace": F.lit("OpenClaw"),
            "model_raw": F.concat(F.lit("[openclaw] "), F.coalesce(J.text(V, "message.modelId", "message.model"), "set_model", F.lit("unknown"))),
            "reported_cost": J.money(V, "message.usage.cost.total"),
            "source_file_line": _line(),
        },
        total=J.integer(V, "message.usage.totalTokens"),
    )


#: Attributes that name a session, with their priority.
SESSION_ATTRIBUTES = (("gen_ai.conversation.id", 3), ("copilot_chat.session_id", 3), ("copilot_chat.chat_session_id", 3), ("session.id", 3), ("github.copilot.interaction_id", 2), ("gen_ai.response.id", 1))


def scan_copilot(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Spans and logs of one call in four kinds; the best kind that shares a trace or response stays.

    Lines are parsed when this is called, and what was read stands in the shared folder.
    """
    lines = J.members(J.members(J.parsed(as_lines(spark, path)), own=F.col(V)), attributes=J.at("own", "attributes"))
    own = lambda *names: J.first(J.text, "own", *names)
    string = lambda *names: J.first(J.text, "attributes", *names)
    whole = lambda *names: J.first(J.integer, "attributes", *names)
    count = lambda *names: F.coalesce(whole(*names), F.lit(0).cast("bigint"))
    has = lambda n: J.has(J.at("own", n), "$")
    inside = lambda n: J.text(J.at("own", "spanContext"), n)
    pairs, numbers = ("endTime", "startTime", "hrTime", "_hrTime", "time"), ("timestamp", "observedTimestamp", "timeUnixNano")
    # Each is read once, as turning a value into a number or an array costs most; what follows reads the columns.
    lines = J.taken(
        lines.select("file_path", "line", "modified_at", "own", "attributes"),
        name=own("name"),
        body=own("body", "_body"),
        is_span=own("type") == "span",
        seems_span=own("spanId", "traceId").isNotNull() | has("startTime") | has("endTime") | has("duration") | has("kind"),
        op=string("gen_ai.operation.name"),
        event=string("event.name"),
        has_attributes=has("attributes"),
        trace_id=F.coalesce(own("traceId"), inside("traceId")),
        span_id=F.coalesce(own("spanId"), inside("spanId")),
        response_id=string("gen_ai.response.id"),
        model=string("gen_ai.response.model", "gen_ai.request.model"),
        sessions=F.array(*(string(k) for k, _ in SESSION_ATTRIBUTES)),
        turn=whole("turn.index", "copilot_chat.turn.index").cast("string"),
        total=whole("gen_ai.usage.total_tokens", "gen_ai.usage.total.token_count"),
        input=count("gen_ai.usage.input_tokens"),
        output=count("gen_ai.usage.output_tokens"),
        cache_create=count("gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation.input_tokens"),
        cache_read=count("gen_ai.usage.cache_read.input_tokens"),
        reasoning=count("gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens"),
        **{f"pair_{n}": F.try_variant_get(J.at("own", n), "$", "array<double>") for n in pairs},
        **{f"number_{n}": J.number(J.at("own", n), "$") for n in numbers},
    )
    name, body, op, event = (F.col(c) for c in ("name", "body", "op", "event"))
    span = F.coalesce("is_span", F.lit(False)) | (name.isNotNull() & F.col("seems_span"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rank = (
        F.when(span & (yes(op == "chat") | yes(name.startswith("chat "))), 1)
        .when(~span & (yes(event == "gen_ai.client.inference.operation.details") | yes(body.startswith("GenAI inference:"))), 2)
        .when(~span & (yes(event == "copilot_chat.agent.turn") | yes(body.startswith("copilot_chat.agent.turn"))), 3)
        .when(span & (yes(op == "invoke_agent") | yes(name.startswith("invoke_agent "))), 4)
    )
    tokens = ("input", "output", "cache_create", "cache_read", "reasoning")
    session = [F.get("sessions", F.lit(i)) for i in range(len(SESSION_ATTRIBUTES))]
    nano = F.col("number_timeUnixNano")
    at = F.coalesce(*(J.pair_time(F.col(f"pair_{n}")) for n in pairs), J.magnitude_time(F.col("number_timestamp")), J.magnitude_time(F.col("number_observedTimestamp")), F.when(nano > 0, F.timestamp_micros(F.round(nano / 1e3).cast("bigint"))), F.col("modified_at"))
    rows = lines.select(
        *("file_path", "line", "has_attributes", "trace_id", "span_id", "response_id", "model", "turn", "total"),
        at.alias("at"),
        rank.alias("kind_rank"),
        F.coalesce(*session).alias("session_id"),
        F.coalesce(*(F.when(s.isNotNull(), F.lit(p)) for s, (_, p) in zip(session, SESSION_ATTRIBUTES, strict=True))).alias("session_priority"),
        F.greatest(F.lit(0).cast("bigint"), F.col("input") - F.col("cache_read")).alias("input"),
        *tokens[1:],
    )
    n = F.row_number().over(Window.partitionBy("file_path").orderBy("line")).cast("bigint") - 1
    rows = staged(rows.withColumn("line", n).filter("has_attributes").drop("has_attributes"), "copilot-rows")  # read by two branches
    context = T.trace_context(rows).select("file_path", "trace_id", F.col("model").alias("trace_model"), F.col("session_id").alias("trace_session"))
    tokens, total = {t: F.col(t) for t in tokens}, F.col("total")
    some = (sum(tokens.values(), F.lit(0)) > 0) | (F.coalesce(total, F.lit(0)) > 0)
    used = T.source_precedence(rows.filter(F.col("kind_rank").isNotNull() & some)).join(context, ["file_path", "trace_id"], "left")
    who = F.coalesce("session_id", "trace_session", "trace_id", F.lit("unknown-session"))
    millis, line = F.unix_millis("at").cast("string"), F.col("line").cast("string")
    traced = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()
    turn = F.coalesce("turn", F.concat(F.lit("idx-"), line))
    request = (
        F.when(F.col("kind_rank").isin(1, 4), F.when(traced, F.concat_ws(":", "trace_id", "span_id")).otherwise(F.concat_ws(":", F.lit("span"), who, millis, line)))
        .when(F.col("kind_rank") == 2, F.when(traced, F.concat_ws(":", F.lit("log"), "trace_id", "span_id")).otherwise(F.concat_ws(":", F.lit("log"), who, millis, line)))
        .otherwise(F.when(F.col("trace_id").isNotNull(), F.concat_ws(":", F.lit("agent-turn"), "trace_id", turn)).otherwise(F.concat_ws(":", F.lit("agent-turn"), who, turn, line)))
    )
    return usage_rows(
        used,
        "copilot",
        tokens,
        {"dedup_key": _key("copilot", request), "timestamp_utc": F.col("at"), "session_id": who, "project_or_workspace": F.lit("GitHub Copilot CLI"), "request_id": request, "model_raw": F.coalesce("model", "trace_model", F.lit("unknown")), "source_file_line": _line()},
        total=total,
    )
