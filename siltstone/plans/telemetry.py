"""Log and stream queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import guardrails as G
from siltstone.operators import telemetry as M
from siltstone.session import shared_path, stored, table
from siltstone.sources import logs as LG
from siltstone.streaming import operators as S


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triage_results").select("correlation_id", "deployment", "event", "latency_ms", "ingested_at").distinct().where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0))


def _failed():
    return F.col("event") == "request_failed"


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(_requests(spark, d).select("deployment", "latency_ms"), "requests")  # the percentiles read it four times
    return M.latency_stats(rows, "latency_ms", ["deployment"], 6)


def slo_by_deployment(spark: SparkSession, d: str) -> DataFrame:
    return M.slo(_requests(spark, d), ~_failed(), 85.0, ["deployment"])


def incident_triage(spark: SparkSession, d: str) -> DataFrame:
    rows = M.triage(_requests(spark, d), "latency_ms", _failed(), "correlation_id", 5)
    return rows.select("correlation_id", "latency_ms", F.col("culprit.span").alias("span"), F.round("culprit.duration_ms", 4).alias("duration_ms"), F.col("culprit.share").alias("share"))


def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).where(M.is_anomalous(F.col("latency_ms"), _failed())).groupBy("deployment").agg(F.count(F.lit(1)).alias("n_anomalies"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_panel(spark: SparkSession, d: str) -> DataFrame:
    """Latency, rate, errors, cost with its running sum by day, tokens and quality per hour."""
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    rows = M.panel(_events(spark, d), "ts", "value", F.col("event_type") == "error", "1 hour", {"cost": F.col("value") * 0.002, "tokens": tokens}, {"quality": F.col("value") / 100})
    rows = M.cumulative(M.cumulative(rows, "window_start", "n_errors", F.to_date("window_start")), "window_start", "cost", F.to_date("window_start"))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("cumulative_cost", F.round("cumulative_cost", 4)).withColumn("tokens", F.col("tokens").cast("bigint"))


def rate_breaches(spark: SparkSession, d: str) -> DataFrame:
    return M.rate_breaches(_events(spark, d), "user_id", "ts", 3600 * 24, 3, "event_id")


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = M.sessions(_events(spark, d), "user_id", "ts", "6 hours")
    return rows.select("user", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


def held_breaches(spark: SparkSession, d: str) -> DataFrame:
    panel = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("mean")).select(F.col("w.start").alias("at"), "mean")
    out = M.held_breaches(panel, F.col("mean") > 45, "at", 3600, 7200)
    return out.select(F.col("run_start").cast("timestamp_ntz").alias("run_start"), F.col("run_end").cast("timestamp_ntz").alias("run_end"), "n_windows")


def audit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Requests received and answered or failed, per session: each start meets one completion."""
    kind = F.when(F.col("event") == "request_received", "start").when(F.col("event").isin("response_sent", "request_failed"), "complete")
    rows = table(spark, d, "triage_results").select("correlation_id", "session_id", "event", "ingested_at").distinct().where(F.col("session_id").isNotNull())
    events = rows.select(F.col("session_id").alias("request_id"), kind.alias("kind"), F.lit("user").alias("user_id"), F.col("ingested_at").alias("ts"), (F.col("event") == "request_failed").alias("blocked"))
    pairs = G.audit_pairs(events)
    return pairs.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("user_id") == "anonymous").alias("n_orphans"), F.count_if("blocked").alias("n_blocked"), F.round(F.sum(F.col("ms") * 1000)).cast("bigint").alias("total_us"))


def stage_log(spark: SparkSession, d: str) -> DataFrame:
    """The requests as stages of their deployment."""
    stages = _requests(spark, d).select(
        "deployment", F.col("event").alias("stage_name"), F.when(_failed(), "FAILED").otherwise("success").alias("status"), F.col("ingested_at").alias("start_time"),
        F.timestamp_micros(F.unix_micros("ingested_at") + F.round(F.col("latency_ms") * 1000).cast("bigint")).alias("end_time"), F.lit(2).cast("bigint").alias("records_processed"), _failed().cast("bigint").alias("records_failed"),
    )
    return M.stage_summary(stages, ["deployment"])


def budget_days(spark: SparkSession, d: str) -> DataFrame:
    """Days on which errors, cost or quality break their limits."""
    limits = {"error_rate": (F.avg(_failed().cast("int")), "max", 0.125), "cost": (F.sum(F.lit(0.01)), "max", 1.8), "success": (F.avg((~_failed()).cast("int")), "min", 0.875)}
    out = M.budget_breaches(_requests(spark, d), "ingested_at", limits)
    return out.select(F.col("day").cast("string").alias("day"), "name", F.round("value", 6).alias("value"), "limit")


def slo_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Service levels given as SQL text, per deployment."""
    return M.conditions(_requests(spark, d), {"fast": "latency_ms <= 3000", "answered": "event <> 'request_failed'", "fast_answer": "latency_ms < 1000 AND event = 'response_sent'"}, ["deployment"])


def incident_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and their first request in the log, with the slowest step of its trace or of the assumed one."""
    t = table(spark, d, "triage_results").select("correlation_id", "session_id", "deployment", "event", "latency_ms", "error_type", "culprit_span", "culprit_duration_ms", "ingested_at").distinct().where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0))
    payload = F.when(F.col("culprit_span").isNotNull(), F.to_json(F.struct(F.create_map(F.col("culprit_span"), F.col("culprit_duration_ms")).alias("spans"))))
    logs = t.select("correlation_id", "latency_ms", "event", "error_type", F.lit(None).cast("string").alias("tool_name"), payload.alias("payload"), F.col("ingested_at").alias("ts"))
    metrics = t.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1)
    out = M.correlated(metrics, logs)
    return out.withColumn("duration_ms", F.round("duration_ms", 4))


def log_window(spark: SparkSession, d: str) -> DataFrame:
    """The request log written as JSON lines with blank and broken lines between, and a time span of it read back."""
    path = shared_path(spark, "log")
    rows = table(spark, d, "triage_results").select("correlation_id", "ts", "deployment", "event", "latency_ms", "error_type").distinct()
    known = F.to_json(F.struct("correlation_id", "ts", F.col("deployment").alias("service"), "event", F.when(~F.isnan("latency_ms"), F.col("latency_ms")).alias("latency_ms"), "error_type"))
    bad = F.when(F.col("event") == "app_started", "{broken").when(F.col("event") == "tool_called", "  ")
    rows.select(F.explode(F.array_compact(F.array(known, bad))).alias("value")).write.text(path)
    found = LG.load_logs(spark, path, "2024-02", "2024-04")
    return found.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_error_type").alias("n_error_keys"), F.round(F.sum("latency_ms"), 3).alias("total_ms"))


# Streams: the tables read as streams, all that is there handled at once, results written to the shared folder and read back.


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")  # a file or a folder


def _closing(spark: SparkSession, d: str, name: str, ts: str, days: int) -> DataFrame:
    """The table as a stream, and one row far behind its end, with -1 in all its other columns: it moves the watermark past every window of the others. (A null key would be filtered out before it could.)"""
    rows = table(spark, d, name)
    path = shared_path(spark, "end")
    end = rows.agg((F.max(F.col(ts).cast("timestamp")) + F.make_interval(days=F.lit(days))).alias("_end"))
    end.select(*[(F.col("_end").cast(t.dataType) if t.name == ts else F.lit(-1).cast(t.dataType)).alias(t.name) for t in rows.schema]).write.parquet(path)
    return _stream(spark, d, name).unionByName(spark.readStream.schema(rows.schema).parquet(path))


def _run(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Every batch's rows, with its number."""
    out = shared_path(spark, "stream")
    write = lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/b={n}")
    schema = stream.schema.add("_batch", "long")
    S.run_available(stream, write, f"{out}/state", mode).awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events sent twice as a stream: replays left out, rows and errors per day, in append mode."""
    stream = _closing(spark, d, "events", "ts", 30)
    once = S.without_replays(stream.unionByName(_stream(spark, d, "events")), "event_id", "ts", late="1 hour")
    rates = S.windowed_rates(once, "ts", F.col("event_type") == "error", "1 day", late=None)
    return _run(spark, rates).drop("_batch").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_slo(spark: SparkSession, d: str) -> DataFrame:
    """Errors over the last seven days, by day: sliding windows, without those that the stream's end cuts off."""
    rates = S.windowed_rates(_closing(spark, d, "events", "ts", 60), "ts", F.col("event_type") == "error", "7 days", "1 day", late="1 hour")
    return _run(spark, rates).drop("_batch").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Running block rates by kind of event, in update mode: the newest row of each."""
    rows = _run(spark, S.block_alerts(_stream(spark, d, "events").withColumn("failed", F.col("value") > 90), F.col("failed"), ["event_type"], 0.09), "update")
    return rows.groupBy("event_type").agg(F.max_by(F.struct("n_calls", "n_blocked", "block_rate", "is_alert"), "_batch").alias("x")).select("event_type", "x.*")


def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Errors joined with the same user's clicks of the six hours before."""
    events = _closing(spark, d, "events", "ts", 30)
    clicks, errors = events.where("event_type = 'click' OR event_id = -1"), events.where("event_type = 'error' OR event_id = -1")
    pairs = S.paired(clicks.select("user_id", "ts", "event_id"), errors.select("user_id", "ts", "event_id"), "user_id", "ts", "6 hours", "1 hour")
    rows = _run(spark, pairs).where(F.col("event_id") != -1)
    return rows.groupBy("event_id").agg(F.count("started_at").alias("n_clicks"), F.max("start_event_id").alias("last_click"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = _run(spark, S.session_counts(_closing(spark, d, "events", "ts", 30), "user_id", "ts", "6 hours", "1 hour")).where(F.col("user") != -1)
    return rows.select("user", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


def stream_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Anomalous events with their slowest assumed step."""
    rows = _run(spark, S.anomalies(_stream(spark, d, "events"), "value", F.col("event_type") == "error", 95.0))
    return rows.select("event_id", F.col("culprit.span").alias("span"), F.round("culprit.duration_ms", 4).alias("duration_ms"))


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Days of users with errors, as a stream of finished windows: an alert once two successive days had one."""
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("n"))
    path = shared_path(spark, "days")
    days.select("user_id", F.col("day").cast("timestamp").alias("at"), (F.col("n") > 0).alias("bad")).write.parquet(path)
    stream = spark.readStream.schema("user_id bigint, at timestamp, bad boolean").parquet(path)
    rows = _run(spark, S.held_alerts(stream, "user_id", "at", "bad", 86400, 2 * 86400))
    return rows.select("series", F.col("run_start").cast("timestamp_ntz").alias("run_start"), F.col("fired_at").cast("timestamp_ntz").alias("fired_at"))


QUERIES = {
    f.__name__: f
    for f in (
        latency_percentiles, slo_by_deployment, slo_conditions, incident_triage, incident_correlation, anomaly_counts, hourly_panel, rate_breaches, user_sessions, held_breaches, audit_pairs, stage_log, budget_days, log_window,
        stream_windows, stream_slo, stream_blocks, stream_pairs, stream_sessions, stream_anomalies, stream_alerts,
    )
}

_REQ = "(SELECT DISTINCT correlation_id, deployment, event, latency_ms, ingested_at FROM triage_results WHERE latency_ms >= 0 AND NOT isnan(latency_ms))"

SQL = {
    "latency_percentiles": f"""
SELECT deployment, count(*)::BIGINT AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.9), 6) AS p90, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99,
  round(avg(latency_ms), 6) AS mean, round(max(latency_ms), 6) AS max FROM {_REQ} GROUP BY 1
""",
    "slo_by_deployment": f"""
SELECT deployment, t AS total, b AS n_bad, round((t - b) * 100.0 / t::DOUBLE, 4) AS sli, a AS allowed_bad, greatest(0, a - b)::BIGINT AS budget_left, round(CASE WHEN a > 0 THEN b / a::DOUBLE ELSE (b > 0)::INTEGER END, 4) AS burn
FROM (SELECT *, floor(t * 15.0 / 100)::BIGINT AS a FROM (SELECT deployment, count(*)::BIGINT AS t, count(*) FILTER (event = 'request_failed')::BIGINT AS b FROM {_REQ} GROUP BY 1))
""",
    "incident_triage": f"""
SELECT correlation_id, latency_ms, CASE WHEN latency_ms > 3000 THEN 'tool' ELSE 'generation' END AS span, round(latency_ms * CASE WHEN latency_ms > 3000 THEN 0.85 ELSE 0.9 END, 4) AS duration_ms,
  CASE WHEN latency_ms > 0 THEN CASE WHEN latency_ms > 3000 THEN 85.0 ELSE 90.0 END ELSE 0.0 END::DOUBLE AS share
FROM {_REQ} WHERE latency_ms > 3000 OR event = 'request_failed' ORDER BY correlation_id LIMIT 5
""",
    "anomaly_counts": f"SELECT deployment, count(*)::BIGINT AS n_anomalies FROM {_REQ} WHERE latency_ms > 3000 OR event = 'request_failed' GROUP BY 1",
    "hourly_panel": """
SELECT window_start, n, n_errors, error_rate, p95, mean_latency, cost, tokens, quality, sum(n_errors) OVER w::BIGINT AS cumulative_n_errors, round(sum(cost) OVER w, 4) AS cumulative_cost FROM (
  SELECT date_trunc('hour', ts) AS window_start, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS n_errors, round(avg((event_type = 'error')::INTEGER), 4) AS error_rate, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean_latency,
    round(sum(value * 0.002), 6) AS cost, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens, round(avg(value / 100), 6) AS quality
  FROM events GROUP BY 1) WINDOW w AS (PARTITION BY window_start::DATE ORDER BY window_start)
""",
    "audit_pairs": """
WITH r AS (SELECT DISTINCT correlation_id, session_id, event, ingested_at FROM triage_results WHERE session_id IS NOT NULL), e AS (SELECT session_id, ingested_at, event = 'request_received' AS s, event = 'request_failed' AS b FROM r WHERE event IN ('request_received', 'response_sent', 'request_failed')),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, s ORDER BY ingested_at) AS k FROM e), p AS (SELECT c.session_id, c.b, epoch_us(c.ingested_at) - epoch_us(a.ingested_at) AS us, a.session_id IS NULL AS orphan FROM n c LEFT JOIN n a ON a.session_id = c.session_id AND a.k = c.k AND a.s WHERE NOT c.s)
SELECT session_id AS request_id, count(*)::BIGINT AS n_pairs, count(*) FILTER (orphan)::BIGINT AS n_orphans, count(*) FILTER (b)::BIGINT AS n_blocked, sum(us)::BIGINT AS total_us FROM p GROUP BY 1
""",
    "stage_log": f"SELECT deployment, count(*)::BIGINT AS n_stages, round(sum(round(latency_ms * 1000) / 1e6), 4) AS seconds, 2 * count(*)::BIGINT AS n_processed, count(*) FILTER (event = 'request_failed')::BIGINT AS n_failed, count(*) FILTER (event = 'request_failed') > 0 AS is_failed FROM {_REQ} GROUP BY 1",
    "budget_days": f"""
WITH v AS (SELECT (ingested_at AT TIME ZONE 'UTC')::DATE::VARCHAR AS day, avg((event = 'request_failed')::INTEGER) AS e, count(*) * 0.01 AS c FROM {_REQ} GROUP BY 1)
SELECT day, 'error_rate' AS name, round(e, 6) AS value, 0.125::DOUBLE AS "limit" FROM v WHERE e > 0.125 UNION ALL SELECT day, 'cost', round(c, 6)::DOUBLE, 1.8 FROM v WHERE round(c, 6) > 1.8 UNION ALL SELECT day, 'success', round(1 - e, 6), 0.875 FROM v WHERE 1 - e < 0.875
""",
    "slo_conditions": f"""
WITH v AS (SELECT deployment, count(*)::BIGINT AS t, count(*) FILTER (latency_ms <= 3000)::BIGINT AS a, count(*) FILTER (event <> 'request_failed')::BIGINT AS b, count(*) FILTER (latency_ms < 1000 AND event = 'response_sent')::BIGINT AS c FROM {_REQ} GROUP BY 1)
SELECT deployment, name, t AS n_total, g AS n_good, round(g / t::DOUBLE, 6) AS ratio FROM (SELECT deployment, t, unnest(['fast', 'answered', 'fast_answer']) AS name, unnest([a, b, c]) AS g FROM v)
""",
    "incident_correlation": """
WITH r AS (SELECT DISTINCT correlation_id, session_id, deployment, event, latency_ms AS ms, error_type, culprit_span AS sp, culprit_duration_ms AS du, ingested_at FROM triage_results WHERE latency_ms >= 0 AND NOT isnan(latency_ms)), o AS (SELECT correlation_id FROM r GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT r.*, sp IS NULL AS assumed, CASE WHEN sp IS NOT NULL THEN sp WHEN ms > 3000 THEN 'retrieval' ELSE 'generation' END AS s, CASE WHEN sp IS NOT NULL THEN du WHEN ms > 3000 THEN ms * 0.85 ELSE ms * 0.9 END AS u FROM r JOIN o USING (correlation_id))
SELECT correlation_id, 1::BIGINT AS n, event, error_type, s AS span, round(u, 4) AS duration_ms, CASE WHEN ms > 0 THEN round(u / ms * 100, 1) ELSE 0.0 END AS share, assumed AS is_assumed FROM x
""",
    "log_window": """
WITH r AS (SELECT DISTINCT correlation_id, coalesce(ts, '') AS ts, ts AS raw, deployment, event, latency_ms, error_type FROM triage_results)
SELECT event, count(*)::BIGINT AS n, count(*) FILTER (error_type IS NOT NULL)::BIGINT AS n_error_keys, round(sum(CASE WHEN NOT isnan(latency_ms) THEN latency_ms END), 3) AS total_ms FROM r WHERE ts >= '2024-02' AND ts <= '2024-04' GROUP BY 1
""",
    "stream_slo": """
WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS t, count(*) AS n, count(*) FILTER (event_type = 'error') AS b FROM events GROUP BY 1), w AS (SELECT t - INTERVAL 1 DAY * k AS window_start, n, b FROM d, range(7) AS r(k))
SELECT window_start, sum(n)::BIGINT AS n, sum(b)::BIGINT AS n_bad, round(sum(b) / sum(n), 6) AS rate FROM w GROUP BY 1
""",
    "stream_blocks": "SELECT event_type, count(*)::BIGINT AS n_calls, count(*) FILTER (value > 90)::BIGINT AS n_blocked, round(count(*) FILTER (value > 90) / count(*)::DOUBLE, 6) AS block_rate, count(*) >= 5 AND count(*) FILTER (value > 90) / count(*)::DOUBLE > 0.09 AS is_alert FROM events GROUP BY 1",
    "stream_pairs": "SELECT e.event_id, count(c.event_id)::BIGINT AS n_clicks, max(c.event_id) AS last_click FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'click' AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 6 HOURS WHERE e.event_type = 'error' GROUP BY 1",
    "stream_anomalies": "SELECT event_id, CASE WHEN value > 95 THEN 'tool' ELSE 'generation' END AS span, round(value * CASE WHEN value > 95 THEN 0.85 ELSE 0.9 END, 4) AS duration_ms FROM events WHERE value > 95 OR event_type = 'error'",
    "stream_alerts": """
WITH d AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, max((event_type = 'error')::INTEGER) AS bad FROM events GROUP BY 1, 2), g AS (SELECT user_id, day, date_diff('day', DATE '2000-01-01', day) - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d WHERE bad > 0)
SELECT user_id::VARCHAR AS series, min(day)::TIMESTAMP AS run_start, (min(day) + INTERVAL 1 DAY)::TIMESTAMP AS fired_at FROM g GROUP BY user_id, k HAVING count(*) >= 2
""",
    "rate_breaches": "SELECT id, user AS user, n_recent FROM (SELECT event_id AS id, user_id AS \"user\", count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)::BIGINT AS n_recent FROM events) WHERE n_recent > 3",
    "user_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS "user", min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, k
""",
    "held_breaches": """
WITH p AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS m FROM events GROUP BY 1), b AS (SELECT h, epoch(h) / 3600 - row_number() OVER (ORDER BY h) AS k FROM p WHERE m > 45)
SELECT min(h) AS run_start, max(h) AS run_end, count(*)::BIGINT AS n_windows FROM b GROUP BY k HAVING count(*) >= 2
""",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS n_bad, round(avg((event_type = 'error')::INTEGER), 6) AS rate FROM events GROUP BY 1",
}
SQL["rate_breaches"] = SQL["rate_breaches"].replace("SELECT id, user AS user,", 'SELECT id, "user",')
SQL["stream_sessions"] = SQL["user_sessions"]
