"""Request logs: latency percentiles, service levels, cost, anomalies and their slowest step, panels per minute, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.quantiles import exact_quantiles, joined_quantiles, widened

#: Windows that are numbered together when runs are found.
EDGE = 1 << 14


def latency_stats(df: DataFrame, value: str, by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """n, exact p50, p90, p95, p99 (linear interpolation), mean and max, rounded; null and NaN are left out. df is read four times, so store what is dear to compute."""
    by = by or []
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).withColumn("_v", v)
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_v"), digits).alias("mean"), F.round(F.max("_v"), digits).alias("max"))
    names = {0.5: "p50", 0.9: "p90", 0.95: "p95", 0.99: "p99"}
    q = widened(exact_quantiles(rows, by, "_v", tuple(names)), by, names, digits)
    return joined_quantiles(out, q, by).select(*by, "n", *names.values(), "mean", "max")


def slo(df: DataFrame, good: Column, target: float = 99.5, by: list[str] | None = None) -> DataFrame:
    """total, n_bad, sli (percent), allowed_bad (whole), budget_left (at least 0), burn (bad per allowed; 1 or 0 if none is allowed)."""
    total, bad = F.count(F.lit(1)), F.count_if(~F.coalesce(good, F.lit(False)))
    out = (df.groupBy(*by) if by else df.groupBy()).agg(total.alias("total"), bad.alias("n_bad"))
    allowed = (F.col("total") * (100.0 - target) / 100.0).cast("bigint")
    sli = F.when(F.col("total") > 0, (F.col("total") - F.col("n_bad")) * 100.0 / F.when(F.col("total") > 0, F.col("total"))).otherwise(100.0)
    burn = F.when(allowed > 0, F.col("n_bad") / F.when(allowed > 0, allowed)).otherwise((F.col("n_bad") > 0).cast("double"))
    return out.select(*(by or []), "total", "n_bad", F.round(sli, 4).alias("sli"), allowed.alias("allowed_bad"), F.greatest(F.lit(0).cast("bigint"), allowed - F.col("n_bad")).alias("budget_left"), F.round(burn, 4).alias("burn"))


def token_cost(df: DataFrame, prices: DataFrame, model: str = "model", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """Adds cost: tokens per million times the model's prices (model, price_in, price_out), or those of the model 'default'. Unknown models without a default cost null."""
    known = prices.select(F.col("model").alias("_m"), "price_in", "price_out")
    default = prices.where(F.col("model") == "default").agg(F.first("price_in").alias("_in"), F.first("price_out").alias("_out"))
    joined = df.join(known, F.col(model) == F.col("_m"), "left").crossJoin(default)  # one row
    cost = F.coalesce(F.col(tokens_in), F.lit(0)) / 1e6 * F.coalesce("price_in", "_in") + F.coalesce(F.col(tokens_out), F.lit(0)) / 1e6 * F.coalesce("price_out", "_out")
    return joined.withColumn("cost", F.round(cost, 6)).drop("_m", "price_in", "price_out", "_in", "_out")


def is_anomalous(latency: Column, failed: Column, threshold: float = 3000.0, with_errors: bool = True) -> Column:
    """A failed request (if they count) or one slower than the threshold; a missing latency counts as 0."""
    slow = F.coalesce(F.when(~F.isnan(latency), latency), F.lit(0.0)) > threshold
    return slow | F.coalesce(failed, F.lit(False)) if with_errors else slow


def default_spans(latency: Column, threshold: float = 3000.0) -> Column:
    """Steps assumed for a request without a trace: mostly the tool if it was slow, else generation."""
    slow = F.create_map(F.lit("tool"), latency * 0.85, F.lit("generation"), latency * 0.15)
    return F.when(latency > threshold, slow).otherwise(F.create_map(F.lit("generation"), latency * 0.9))


def slowest_span(spans: Column, total: Column) -> Column:
    """struct(span, duration_ms, share percent) of the longest step; of equal ones the first by name; ('unknown', 0, 0) without steps."""
    longest = F.array_max(F.map_values(spans))
    name = F.array_min(F.filter(F.map_keys(spans), lambda k: F.element_at(spans, k) == longest))
    share = F.when(total > 0, F.round(longest / F.when(total > 0, total) * 100, 1)).otherwise(0.0)
    some = F.coalesce(F.size(spans), F.lit(0)) > 0
    return F.struct(F.when(some, name).otherwise("unknown").alias("span"), F.when(some, longest).otherwise(0.0).alias("duration_ms"), F.when(some, share).otherwise(0.0).alias("share"))


def triage(logs: DataFrame, latency: str, failed: Column, order: str, most: int = 5, threshold: float = 3000.0) -> DataFrame:
    """The first anomalies in order, at most ``most``, with their slowest assumed step: the body of an incident report."""
    rows = logs.where(is_anomalous(F.col(latency), failed, threshold)).orderBy(order).limit(most)
    return rows.withColumn("culprit", slowest_span(default_spans(F.coalesce(F.col(latency), F.lit(0.0)), threshold), F.coalesce(F.col(latency), F.lit(0.0))))


def panel(logs: DataFrame, ts: str, latency: str, failed: Column, width: str = "1 minute", sums: dict[str, Column] | None = None, means: dict[str, Column] | None = None) -> DataFrame:
    """Per window: n, n_errors, error_rate, exact p95 and mean latency, and further sums (cost, tokens) and means (quality) by name."""
    rows = logs.withColumns({"_bad": F.coalesce(failed, F.lit(False)).cast("int"), "_v": F.col(latency).cast("double"), "window_start": F.window(ts, width)["start"]}).where(F.col("window_start").isNotNull())
    more = [F.round(F.sum(c), 6).alias(n) for n, c in (sums or {}).items()] + [F.round(F.avg(c), 6).alias(n) for n, c in (means or {}).items()]
    out = rows.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("n_errors"), F.round(F.avg("_bad"), 4).alias("error_rate"), F.round(F.avg("_v"), 6).alias("mean_latency"), *more)
    q = widened(exact_quantiles(rows, ["window_start"], "_v", (0.95,)), ["window_start"], {0.95: "p95"}, 6)
    return joined_quantiles(out, q, ["window_start"]).select("window_start", "n", "n_errors", "error_rate", "p95", "mean_latency", *(sums or {}), *(means or {}))


def cumulative(panel_rows: DataFrame, order: str, value: str, day: Column) -> DataFrame:
    """Running sum of a panel's value inside each day: days are the partitions, so no window sees more than a day of panels."""
    return panel_rows.withColumn("_day", day).withColumn(f"cumulative_{value}", F.sum(value).over(Window.partitionBy("_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("_day")


def rate_breaches(events: DataFrame, user: str, ts: str, seconds: int, limit: int, id_col: str) -> DataFrame:
    """Events that are more than the limit-th of their user in the trailing seconds (both ends included): id, user, n_recent.

    A user's events are cut into spans of the window's length; each event is counted
    against its own span and the one before, so the work of a hot user is spread
    over time instead of one partition.
    """
    e = events.select(F.col(id_col).alias("id"), F.col(user).alias("user"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where(F.col("us").isNotNull() & F.col("user").isNotNull())
    span = F.floor(F.col("us") / (seconds * 1_000_000))
    # each event also stands in the next span, as one that only counts
    both = e.withColumn("span", span).withColumn("own", F.lit(True)).unionByName(e.withColumn("span", span + 1).withColumn("own", F.lit(False)))
    w = Window.partitionBy("user", "span").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return both.withColumn("n_recent", F.count(F.lit(1)).over(w)).where(F.col("own") & (F.col("n_recent") > limit)).select("id", "user", "n_recent")


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """user, session_start, session_end (of the last event plus the gap), n_events."""
    return events.groupBy(F.col(user).alias("user"), F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events")).select("user", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def held_breaches(panel_rows: DataFrame, breached: Column, order: str, width_seconds: int, hold_seconds: int, by: Column | None = None) -> DataFrame:
    """Runs of successive breached windows that last at least hold_seconds: run_start, run_end, n_windows. A missing window ends a run.

    A breached window begins a run if the one before it isn't breached, and ends one if
    the one after it isn't. A span of EDGE windows of one series is numbered by itself, and the
    pieces of a run that crosses spans are joined by their number, so no task sees a
    whole series.
    """
    rows = panel_rows.where(F.coalesce(breached, F.lit(False))).select((by if by is not None else F.lit(0)).alias("_by"), F.col(order).alias("_at"), F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / width_seconds).alias("_n")).dropDuplicates(["_by", "_n"])
    inside = Window.partitionBy("_by", "_span").orderBy("_n")
    pieces = rows.withColumn("_span", F.floor(F.col("_n") / EDGE)).withColumn("_piece", F.col("_n") - F.row_number().over(inside)).groupBy("_by", "_span", "_piece").agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"), F.min("_at").alias("_start"), F.max("_at").alias("_end"))
    # pieces are runs inside a span: far fewer than windows unless every other window is breached
    over = Window.partitionBy("_by").orderBy("_first")
    fresh = (F.lag("_last").over(over) != F.col("_first") - 1) | F.lag("_last").over(over).isNull()
    runs = pieces.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(over)).groupBy("_by", "_run").agg(F.min("_start").alias("run_start"), F.max("_end").alias("run_end"), F.sum(F.col("_last") - F.col("_first") + 1).alias("n_windows"))
    return runs.where(F.col("n_windows") * width_seconds >= hold_seconds).select("run_start", "run_end", "n_windows")


def stage_summary(stages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_stages, seconds (sum), n_processed, n_failed, is_failed (any stage failed) of a stage log (stage_name, status, start_time, end_time, records_processed, records_failed)."""
    return (stages.groupBy(*by) if by else stages.groupBy()).agg(
        F.count(F.lit(1)).alias("n_stages"), F.round(F.sum((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6), 4).alias("seconds"),
        F.sum("records_processed").alias("n_processed"), F.sum("records_failed").alias("n_failed"), F.coalesce(F.bool_or(F.lower("status") == "failed"), F.lit(False)).alias("is_failed"),
    )


def budget_breaches(logs: DataFrame, ts: str, limits: dict[str, tuple[Column, str, float]]) -> DataFrame:
    """Days that break a limit: day, name, value, limit. limits: name -> (aggregate over a day's rows, 'max' or 'min', bound)."""
    daily = logs.groupBy(F.to_date(ts).alias("day")).agg(*[agg.cast("double").alias(name) for name, (agg, _, _) in limits.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(float(b)).alias("limit"), F.lit(kind).alias("kind")) for n, (_, kind, b) in limits.items()])
    broken = F.when(F.col("kind") == "max", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return daily.select("day", F.explode(rows).alias("x")).select("day", "x.*").where(broken).drop("kind")


def correlated(metrics: DataFrame, logs: DataFrame, key: str = "correlation_id", latency: str = "latency_ms", spans: str = "payload", threshold: float = 3000.0) -> DataFrame:
    """Metric rows with their log row and its slowest step: key, the metric's columns, event, error_type, span, duration_ms, share, is_assumed.

    logs has the key, latency, event, error_type, tool_name and a JSON payload whose
    "spans" maps steps to milliseconds; without it the steps are assumed from latency
    and tool. A key's first log row by ts counts; metrics without a log row keep nulls.
    """
    first = logs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(F.col(latency).alias("ms"), "event", "error_type", "tool_name", F.col(spans).alias("payload")), F.struct("ts", F.xxhash64(latency, "event"))).alias("_log"))
    joined = metrics.join(first, F.col(key) == F.col("_key"), "left").withColumn("_ms", F.coalesce(F.col("_log.ms"), F.lit(0.0))).withColumn("_spans", parsed_spans(F.col("_log.payload")))
    known = F.coalesce(F.size("_spans"), F.lit(0)) > 0
    tool = F.coalesce("_log.tool_name", F.lit("retrieval"))
    assumed = F.when(F.col("_ms") > threshold, F.create_map(tool, F.col("_ms") * 0.85, F.lit("generation"), F.col("_ms") * 0.15)).otherwise(F.create_map(F.lit("generation"), F.col("_ms") * 0.9))
    culprit = slowest_span(F.when(known, F.col("_spans")).otherwise(assumed), F.col("_ms"))
    some = F.col("_log").isNotNull()
    out = joined.withColumn("_c", culprit)
    return out.select(*[F.col(f"`{c}`") for c in metrics.columns], F.col("_log.event").alias("event"), F.col("_log.error_type").alias("error_type"), F.when(some, F.col("_c.span")).alias("span"), F.when(some, F.col("_c.duration_ms")).alias("duration_ms"), F.when(some, F.col("_c.share")).alias("share"), F.when(some, ~known).alias("is_assumed"))


def parsed_spans(payload: Column) -> Column:
    """The steps of a log row's payload: map of name to milliseconds, null without any."""
    return F.from_json(F.get_json_object(payload, "$.spans"), "map<string,double>")


def conditions(df: DataFrame, rules: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """name, n_total, n_good, ratio of conditions given as SQL text, one row per (group and) condition; unknown outcomes aren't good, and 1 is the ratio of nothing."""
    flags = [F.count_if(F.coalesce(F.expr(sql), F.lit(False))).alias(f"_{i}") for i, sql in enumerate(rules.values())]
    counted = (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("n_total"), *flags)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{i}").alias("n_good")) for i, name in enumerate(rules)]))
    return counted.select(*(by or []), "n_total", rows.alias("x")).select(*(by or []), "x.name", "n_total", "x.n_good", F.when(F.col("n_total") > 0, F.round(F.col("x.n_good") / F.when(F.col("n_total") > 0, F.col("n_total")), 6)).otherwise(1.0).alias("ratio"))
