"""Streaming forms of the log operators. Late rows: each operator takes a watermark; windows close in append mode.

Times must be TIMESTAMP: streams refuse watermarks on TIMESTAMP_NTZ, so as_event_time casts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def as_event_time(stream: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_rates(stream: DataFrame, ts: str, failed: Column, width: str = "1 minute", slide: str | None = None, late: str | None = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """n, n_bad and rate per window (sliding if slide is given, such as a rolling service level over '28 days' by '1 day'). late None: the stream has its watermark already."""
    rows = (as_event_time(stream, ts, late) if late else stream).withColumn("_bad", F.coalesce(failed, F.lit(False)).cast("int"))
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("n_bad"), F.round(F.avg("_bad"), 6).alias("rate"))
    return out.select(F.col("w.start").alias("window_start"), *(by or []), "n", "n_bad", "rate")


def block_alerts(stream: DataFrame, blocked: Column, by: list[str], most: float = 0.4, least_calls: int = 5) -> DataFrame:
    """Running block rates for update mode; the state is one row per group."""
    from siltstone.operators.guardrails import block_rates

    return block_rates(stream, blocked, by, most, least_calls)


def without_replays(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return as_event_time(stream, ts, late).dropDuplicatesWithinWatermark([key])


def paired(starts: DataFrame, completions: DataFrame, key: str, ts: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Completions with their starts, if the start is at most ``within`` older; completions without one come out with nulls once the watermark has passed."""
    s = as_event_time(starts, ts, late).select(F.col(key).alias("_key"), F.col(ts).alias("started_at"), *[F.col(c).alias(f"start_{c}") for c in starts.columns if c not in (key, ts)])
    c = as_event_time(completions, ts, late)
    near = (F.col("_key") == F.col(key)) & (F.col("started_at") <= F.col(ts)) & (F.col("started_at") >= F.col(ts) - F.expr(f"INTERVAL {within}"))
    return c.join(s, near, "left_outer").drop("_key")


def session_counts(stream: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = as_event_time(stream, ts, late)
    return rows.groupBy(F.col(user).alias("user"), F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events")).select("user", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def anomalies(stream: DataFrame, latency: str, failed: Column, threshold: float = 3000.0) -> DataFrame:
    """Stateless: anomalous rows with their slowest assumed step."""
    from siltstone.operators.telemetry import default_spans, is_anomalous, slowest_span

    value = F.coalesce(F.col(latency), F.lit(0.0))
    return stream.where(is_anomalous(F.col(latency), failed, threshold)).withColumn("culprit", slowest_span(default_spans(value, threshold), value))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Handles all that is there, batch by batch, and stops; write gets (rows, batch number) and must be repeatable per number."""
    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held_alerts(windows: DataFrame, series: str, at: str, breached: str, width_seconds: int, hold_seconds: int) -> DataFrame:
    """One alert per run of successive breached windows once it has held hold_seconds: series, run_start, fired_at.

    windows is a stream of finished windows; those of one batch are taken in order,
    and a window older than the last one seen is left out. A missing window ends a
    run. The state is three numbers a series.
    """
    need = max(1, -(-hold_seconds // width_seconds))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, length = state.get if state.exists else (0, -1, 0)
        fired = []
        rows = pd.concat(list(batches)).drop_duplicates("at").sort_values("at")
        for second, bad in zip(rows["at"].tolist(), rows["bad"].tolist(), strict=True):
            if second <= last:
                continue
            if not bad:
                length = 0
            elif length and second == last + width_seconds:
                length += 1
            else:
                start, length = second, 1
            last = second
            if length == need:
                fired.append((key[0], start, second))
        state.update((start, last, length))
        yield pd.DataFrame(fired, columns=["series", "start", "fired"])

    rows = windows.select(F.col(series).cast("string").alias("series"), F.unix_seconds(F.col(at).cast("timestamp")).alias("at"), F.coalesce(F.col(breached), F.lit(False)).alias("bad")).where(F.col("at").isNotNull() & F.col("series").isNotNull())
    out = rows.groupBy("series").applyInPandasWithState(step, "series string, start long, fired long", "start long, last long, length long", "append", GroupStateTimeout.NoTimeout)
    return out.select("series", F.timestamp_seconds("start").alias("run_start"), F.timestamp_seconds("fired").alias("fired_at"))
