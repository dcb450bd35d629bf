"""Schemas of the tables that operators pass to each other."""

from __future__ import annotations

TOKENS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "reasoning_tokens")
MONEY = "decimal(30,12)"
#: Price of one token. Rates a million are multiplied by 0.000001 once, so no division rounds.
RATE = "decimal(14,12)"

USAGE_EVENT = (
    "source_id string, dedup_key string, is_sidechain_replay boolean, timestamp_utc timestamp, session_id string, project_or_workspace string, request_id string, "
    "model_raw string, model_family string, input_tokens bigint, output_tokens bigint, cache_create_tokens bigint, cache_read_tokens bigint, reasoning_tokens bigint, "
    f"cost_usd {MONEY}, cost_is_estimated boolean, source_file_path string, source_file_line bigint"
)
HOUR_BUCKET = f"device_id string, hour_utc timestamp, source_id string, model_family string, {', '.join(f'{t} bigint' for t in TOKENS)}, cost_usd {MONEY}, event_count bigint, estimated_event_count bigint"
FILE_STATE = "file_path string, source_id string, byte_offset bigint, line_index bigint, file_size bigint, file_mtime timestamp"
PRICE = f"family string, input_rate {RATE}, output_rate {RATE}, cache_write_rate {RATE}, cache_read_rate {RATE}"
