"""Request logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "ts string, level string, service string, correlation_id string, user_id_hash string, session_id string, feature string, model string, env string, event string, "
    "latency_ms double, ttft_ms double, tokens_in bigint, tokens_out bigint, cost_usd double, quality_score double, error_type string, tool_name string, payload string"
)


def parse_logs(lines: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Log rows of a text column ``value`` (batch or stream): the fields of SCHEMA and has_error_type (the key is there, even with null).

    Blank and malformed lines are left out. start and end compare with ts as text,
    both included; a missing ts counts as ''.
    """
    ok = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    parsed = lines.where(ok).select(F.from_json("value", SCHEMA).alias("x"), F.coalesce(F.array_contains(F.json_object_keys("value"), "error_type"), F.lit(False)).alias("has_error_type")).select("x.*", "has_error_type")
    at = F.coalesce("ts", F.lit(""))
    if start is not None:
        parsed = parsed.where(at >= start)
    if end is not None:
        parsed = parsed.where(at <= end)
    return parsed


def load_logs(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return parse_logs(spark.read.text(path), start, end)
