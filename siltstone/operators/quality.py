"""Quality gate and freshness of tables: every rule in one aggregation pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.quantiles import exact_quantiles, joined_quantiles, widened


@dataclass(frozen=True)
class GateRules:
    """required and unique: columns. min_length: column -> characters. custom: name -> SQL predicate that every row must meet."""

    min_rows: int = 1
    max_rows: int | None = 100_000
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    min_length: dict[str, int] = field(default_factory=dict)
    custom: dict[str, str] = field(default_factory=dict)


def _absent(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else c.isNull()


def quality_gate(df: DataFrame, rules: GateRules) -> DataFrame:
    """One row per rule: rule, column_name, severity, passed, observed.

    Row bounds, missing values and duplicates are BLOCKERs, short values and custom
    predicates WARNINGs. A required column that doesn't exist fails its rule; unique
    and length rules for absent columns are left out. Nulls equal each other; null
    values count as short. Duplicates = rows less distinct values.
    """
    n = F.count(F.lit(1))
    found: list[tuple[str, str | None, str, Column, Column]] = [("row_count", None, "BLOCKER", n, (n >= rules.min_rows) & (n <= rules.max_rows if rules.max_rows is not None else F.lit(True)))]
    for c in rules.required:
        bad = F.count_if(_absent(df, c)) if c in df.columns else n
        found.append(("not_null", c, "BLOCKER", bad, bad == 0 if c in df.columns else F.lit(False)))
    for c in rules.unique:
        if c in df.columns:
            bad = n - (F.count_distinct(F.col(f"`{c}`")) + F.coalesce(F.max(F.col(f"`{c}`").isNull().cast("int")), F.lit(0)))
            found.append(("unique", c, "BLOCKER", bad, bad == 0))
    for c, least in rules.min_length.items():
        if c in df.columns:
            bad = F.count_if(F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) < least)
            found.append(("min_length", c, "WARNING", bad, bad == 0))
    for name, predicate in rules.custom.items():
        bad = F.count_if(~F.coalesce(F.expr(predicate), F.lit(False)))
        found.append((f"custom:{name}", None, "WARNING", bad, bad == 0))
    one = df.agg(*[F.struct(observed.cast("bigint").alias("observed"), passed.alias("passed")).alias(f"r{i}") for i, (_, _, _, observed, passed) in enumerate(found)])
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(c).cast("string").alias("column_name"), F.lit(s).alias("severity"), F.col(f"r{i}.passed").alias("passed"), F.col(f"r{i}.observed").alias("observed")) for i, (rule, c, s, _, _) in enumerate(found)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def verdict(results: DataFrame) -> DataFrame:
    """One row: passed (no failed BLOCKER), has_warnings, n_rules, n_failed."""
    failed = ~F.col("passed")
    return results.agg(
        (F.count_if(failed & (F.col("severity") == "BLOCKER")) == 0).alias("passed"), (F.count_if(failed & (F.col("severity") == "WARNING")) > 0).alias("has_warnings"),
        F.count(F.lit(1)).alias("n_rules"), F.count_if(failed).alias("n_failed"),
    )


def freshness(df: DataFrame, ts: str, reference: Column, max_age_days: float = 180.0, most_stale: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """n, n_valid, n_stale, stale_ratio (over all rows), is_fresh, min, max and median age in days.

    Times that can't be read are no stale rows but count in the ratio's base. Without
    rows, or with no readable time, nothing is fresh and every row counts as stale.
    The median is exact; df is read four times.
    """
    at = F.expr(f"try_cast(`{ts}` AS timestamp)") if dict(df.dtypes)[ts] == "string" else F.col(f"`{ts}`").cast("timestamp")
    age = (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(at)) / F.lit(86400e6)
    rows = df.withColumn("_age", age)
    n, valid = F.count(F.lit(1)), F.count("_age")
    stale = F.when(valid == 0, n).otherwise(F.count_if(F.col("_age") > max_age_days))
    ratio = F.when(n > 0, stale / F.when(n > 0, n)).otherwise(F.lit(1.0))
    by = by or []
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        n.alias("n"), valid.alias("n_valid"), stale.alias("n_stale"), F.round(ratio, 4).alias("stale_ratio"), ((valid > 0) & (ratio <= most_stale)).alias("is_fresh"),
        F.round(F.min("_age"), 4).alias("min_age_days"), F.round(F.max("_age"), 4).alias("max_age_days"),
    )
    return joined_quantiles(out, widened(exact_quantiles(rows, by, "_age", (0.5,)), by, {0.5: "median_age_days"}, 4), by)


def document_faults(df: DataFrame, id_col: str = "id", text: str = "content", metadata: str | None = "metadata", index: str | None = None) -> DataFrame:
    """First fault per row: id, fault ('no_id', 'no_content', 'no_metadata', 'no_source', 'no_title', 'bad_index'); rows without fault are left out."""
    from siltstone.functions.text import is_blank

    fault = F.when(is_blank(F.col(id_col).cast("string")), "no_id").when(is_blank(F.col(text)), "no_content")
    if metadata:
        m = F.col(metadata)
        fault = fault.when(m.isNull(), "no_metadata").when(is_blank(F.try_element_at(m, F.lit("source"))), "no_source").when(is_blank(F.try_element_at(m, F.lit("title"))), "no_title")
    if index:
        fault = fault.when(F.col(index).isNull() | (F.col(index) < 0), "bad_index")
    return df.select(F.col(id_col).alias("id"), fault.alias("fault")).where(F.col("fault").isNotNull())
