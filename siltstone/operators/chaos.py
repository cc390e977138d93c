"""Controlled faults for testing gates, and the audit of damage and repair.

Rows are chosen by the rank of a hash of id and seed, so a plan picks the same rows
at every run, on every engine and in every partitioning. The k smallest hashes are
found through a threshold from counted histograms of hash prefixes, never by one
global sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.quality import verdict
from siltstone.sources.store import upsert


def _hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def _id_prefixes(df: DataFrame, id_col: str) -> list[Column]:
    """Coarser forms of an id that sort as it does, so that equal times are told apart by counts, too."""
    c = F.col(f"`{id_col}`")
    if dict(df.dtypes)[id_col] == "string":
        return [F.substring(c, 1, n) for n in (4, 8, 12, 16)]
    return [F.floor(c / F.lit(float(1 << n))) for n in (40, 24, 10)]


def _kth(df: DataFrame, prefixes: list[Column], order: list[Column], k: int, descending: bool = False) -> list | None:
    """The values of order in the k-th row; null if there are fewer rows.

    Counts per prefix, level by level, lead to the bucket that holds it, so only that
    bucket's rows are sorted. Prefixes must sort as the rows do.
    """
    rows, left = df, k
    for p in prefixes:
        counts = rows.groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("p").desc_nulls_last() if descending else F.col("p").asc_nulls_first()).collect()  # one count per prefix
        edge = None
        for r in counts:
            if left <= r["n"]:
                edge = r
                break
            left -= r["n"]
        if edge is None:
            return None
        rows = rows.where(p.eqNullSafe(F.lit(edge["p"])))
    forward = [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in order]
    back = [c.asc_nulls_first() if descending else c.desc_nulls_last() for c in order]
    named = [c.alias(f"_{i}") for i, c in enumerate(order)]
    first = rows.orderBy(*forward).limit(left).orderBy(*back).select(*named).first()  # one row
    return list(first)


def _smallest(df: DataFrame, key: Column, k: int, tie: str) -> Column:
    """Condition that holds for the k rows with the smallest (key, tie). key: lower-case hex text, evenly spread."""
    if k <= 0:
        return F.lit(False)
    edge = _kth(df, [F.substring(key, 1, 3), F.substring(key, 1, 6)], [key, F.col(tie)], k)
    return F.lit(True) if edge is None else (key < edge[0]) | ((key == edge[0]) & (F.col(tie) <= F.lit(edge[1])))


def sample_condition(df: DataFrame, id_col: str, fraction: float, seed: int) -> Column:
    """Exactly round(fraction * rows) rows, half to even."""
    return _smallest(df, _hash(id_col, seed), round(fraction * df.count()), id_col)


def drop_latest(df: DataFrame, ts: str, id_col: str, fraction: float = 0.2) -> DataFrame:
    """Without the latest max(1, int(fraction * n)) rows, if there are more than four; equal times go by the larger id first. Null times are oldest."""
    n = df.count()
    if n <= 4:
        return df
    text = F.col(ts).cast("string")  # sorts as the times do
    edge = _kth(df, [F.substring(text, 1, 10), F.substring(text, 1, 19), text, *_id_prefixes(df, id_col)], [F.col(ts), F.col(id_col)], max(1, int(fraction * n)), descending=True)
    if edge[0] is None:
        return df.where(F.col(ts).isNull() & (F.col(id_col) < F.lit(edge[1])))
    return df.where(F.col(ts).isNull() | (F.col(ts) < F.lit(edge[0])) | ((F.col(ts) == F.lit(edge[0])) & (F.col(id_col) < F.lit(edge[1]))))


def blank_text(df: DataFrame, text: str, id_col: str, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    return df.withColumn(text, F.when(sample_condition(df, id_col, fraction, seed), "").otherwise(F.col(text)))


def add_noise(df: DataFrame, text: str, id_col: str, fraction: float = 0.15, seed: int = 43, token: str = " ###NOISE###") -> DataFrame:
    """Appends the token three times; a null text becomes the tokens."""
    return df.withColumn(text, F.when(sample_condition(df, id_col, fraction, seed), F.concat(F.coalesce(text, F.lit("")), F.lit(token * 3))).otherwise(F.col(text)))


def truncate_title(df: DataFrame, title: str, id_col: str, fraction: float = 0.15, seed: int = 44) -> DataFrame:
    """Cuts the title to six characters; null and empty ones become 'Trun'."""
    short = F.when(F.coalesce(title, F.lit("")) == "", "Trun").otherwise(F.substring(title, 1, 6))
    return df.withColumn(title, F.when(sample_condition(df, id_col, fraction, seed), short).otherwise(F.col(title)))


def backdate(df: DataFrame, ts: str, id_col: str, fraction: float = 0.25, seed: int = 45, days: int = 365) -> DataFrame:
    """ts becomes 'yyyy-MM-dd' text, set back by days where chosen; unreadable times become null there."""
    at = F.expr(f"try_cast(`{ts}` AS timestamp)")
    return df.withColumn(ts, F.when(sample_condition(df, id_col, fraction, seed), F.date_format(at - F.make_interval(days=F.lit(days)), "yyyy-MM-dd")).otherwise(F.col(ts).cast("string")))


def duplicate_rows(df: DataFrame, id_col: str, fraction: float = 0.15, seed: int = 46) -> DataFrame:
    return df.unionByName(df.where(sample_condition(df, id_col, fraction, seed)))


def compare_states(states: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """metric, one column per state (its one-row summary), and the last state's change against the first and the second: delta_total, delta_repaired."""
    names = list(states)
    out = None
    for name, summary in states.items():
        part = summary.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*")
        out = part if out is None else out.join(part, "metric")
    return out.withColumn("delta_total", F.col(names[-1]) - F.col(names[0])).withColumn("delta_repaired", F.col(names[-1]) - F.col(names[1]))


@dataclass(frozen=True)
class FaultPlan:
    """Shares of the rows that each fault meets, days that stale times are set back, and the first seed."""

    drop: float = 0.20
    blank: float = 0.15
    noise: float = 0.15
    truncate: float = 0.15
    stale: float = 0.25
    duplicate: float = 0.15
    stale_days: int = 365
    seed: int = 42


def inject(df: DataFrame, id_col: str, text: str, ts: str | None = None, title: str | None = None, plan: FaultPlan = FaultPlan()) -> tuple[DataFrame, DataFrame]:
    """(the rows with the plan's faults in sequence, a report fault, n_affected, n_before, n_after).

    Order: latest rows dropped, text blanked, noise appended, titles cut, times set
    back, rows repeated; each picks among the rows that the steps before left. Faults
    whose column isn't there are left out.
    """
    steps = [("blank", text, lambda d: blank_text(d, text, id_col, plan.blank, plan.seed), plan.blank), ("noise", text, lambda d: add_noise(d, text, id_col, plan.noise, plan.seed + 1), plan.noise)]
    if title in df.columns:
        steps.append(("truncate", title, lambda d: truncate_title(d, title, id_col, plan.truncate, plan.seed + 2), plan.truncate))
    if ts in df.columns:
        steps.append(("stale", ts, lambda d: backdate(d, ts, id_col, plan.stale, plan.seed + 3, plan.stale_days), plan.stale))
    n_before, out, report = df.count(), df, []
    if ts in df.columns:
        out = drop_latest(df, ts, id_col, plan.drop)
        if n_before > 4:
            report.append(("drop", ts, max(1, int(plan.drop * n_before))))
    n = n_before - (report[0][2] if report else 0)
    for name, column, step, share in steps:
        if column in df.columns and n:
            out = step(out)
            report.append((name, column, round(share * n)))
    if n:
        out = duplicate_rows(out, id_col, plan.duplicate, plan.seed + 4)
        report.append(("duplicate", id_col, round(plan.duplicate * n)))
    n_after = n + (report[-1][2] if n else 0)
    rows = [(name, column, k, n_before, n_after) for name, column, k in report]
    return out, df.sparkSession.createDataFrame(rows, "fault string, column_name string, n_affected bigint, n_before bigint, n_after bigint")


def replayed(raw: DataFrame, store: DataFrame, clean: Callable[[DataFrame], DataFrame], passes: Callable[[DataFrame], DataFrame], id_col: str = "id", version: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the store after the replay, one row n_clean, passed, is_reindexed).

    The raw snapshot is cleaned again and put through the gate (passes: rows -> its
    rule results); only if that passes, or if forced, the store gets the rows, each id
    once. A second replay changes nothing.
    """
    rows = latest_versions(clean(raw), id_col, version) if version else clean(raw)
    result = rows.agg(F.count(F.lit(1)).alias("n_clean")).crossJoin(verdict(passes(rows)).select("passed"))  # one row each
    result = result.withColumn("is_reindexed", F.col("passed") | F.lit(force))
    goes = bool(result.first()["is_reindexed"])
    return (upsert(store, rows, id_col, version) if goes else store), result


def audit(states: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """One row per state (its rows, gate results, freshness row): state, n_rows, quality_passed, freshness_passed, and quality_restored (passed here, but not in the state before)."""
    out, before = None, None
    for k, (name, (rows, gate, fresh)) in enumerate(states.items()):
        part = rows.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(verdict(gate).select(F.col("passed").alias("quality_passed"))).crossJoin(fresh.agg(F.coalesce(F.bool_and("is_fresh"), F.lit(False)).alias("freshness_passed")))  # one row each
        part = part.select(F.lit(k).alias("place"), F.lit(name).alias("state"), "n_rows", "quality_passed", "freshness_passed")
        out = part if out is None else out.unionByName(part)
    before = F.lag("quality_passed").over(Window.partitionBy(F.lit(0)).orderBy("place"))  # a handful of states
    return out.withColumn("quality_restored", F.coalesce(F.col("quality_passed") & ~before, F.lit(False))).drop("place")


def latest_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key: idempotent upsert of replays. Equal versions are told apart by all columns, so the choice is the same every time; null keys are dropped."""
    packed = F.struct(F.col(version).alias("_v"), *[F.col(f"`{c}`") for c in sorted(rows.columns) if c not in (key, version) and not dict(rows.dtypes)[c].startswith("map")])
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != key]), packed).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, the others); an unknown outcome is no pass."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)
