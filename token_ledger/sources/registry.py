"""One name for every scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_agents as D
from . import line_agents as L
from .events import priced

#: Agents whose logs are files under a folder.
FILE_SCANS: dict[str, Callable[[SparkSession, str | DataFrame], DataFrame]] = {
    "claude-code": L.scan_claude,
    "codex-cli": L.scan_codex,
    "gemini-cli": L.scan_gemini,
    "qwen": L.scan_qwen,
    "kimi": L.scan_kimi,
    "pi": L.scan_pi,
    "oh-my-pi": L.scan_omp,
    "openclaw": L.scan_openclaw,
    "copilot": L.scan_copilot,
    "amp": D.scan_amp,
    "droid": D.scan_droid,
    "opencode": D.read_opencode_files,
}
#: Agents whose logs are tables, exported to any format that Spark reads.
TABLE_SCANS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"opencode": D.scan_message_table, "kilo": D.scan_message_table, "goose": D.scan_session_table, "hermes": D.scan_session_table}


def scan(spark: SparkSession, agent: str, path: str | DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Usage rows of an agent from a folder of logs, or from an exported table (a DataFrame); with prices, usage events."""
    raw = FILE_SCANS[agent](spark, path) if isinstance(path, str) else TABLE_SCANS[agent](path, agent)
    return raw if prices is None else priced(raw, prices)
