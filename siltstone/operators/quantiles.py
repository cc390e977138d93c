"""Exact percentiles per group without any group's values in one place.

A mergeable sketch brackets each percentile between two values; the rows between
them are counted in cells, and only the cell that holds the rank is looked at value
by value. So a hot group costs three combined aggregations, not one large buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import stored

#: Size of the bracketing sketch; its brackets hold about one value in a hundred.
SKETCH = 1600
#: Share of the ranks by which a bracket is widened on either side: well beyond the sketch's error (0.3 % at 99 %).
MARGIN = 0.01
#: Groups of fewer values are bracketed by their least and largest value.
FEW = 1_000
#: Cells that a bracket is cut into.
CELLS = 1024


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """by, q, value: the q-th percentile of every group, linearly interpolated. Null and NaN are left out; groups without values have no row.

    df is read three times. Two ranks (the floor and the ceiling of q * (n - 1)) are
    looked up for each percentile. Group keys may be null.
    """
    rows = df.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    keys = [f"_g{i}" for i in range(len(by))]
    sketch = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", SKETCH).alias("_s"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))

    def bracket(q: float) -> Column:
        end = lambda at, outer: outer if not 0 < at < 1 else F.when(F.col("_n") < FEW, outer).otherwise(F.kll_sketch_get_quantile_double("_s", F.lit(at)))
        return F.struct(F.lit(float(q)).alias("_q"), end(q - MARGIN, F.col("_least")).alias("_lo"), end(q + MARGIN, F.col("_most")).alias("_hi"))

    at = (F.col("_n") - 1) * F.col("_q")
    # sketches toss coins, so the brackets are kept: both passes below must see the same
    brackets = stored(
        sketch.select(*keys, "_n", F.explode(F.array(*map(bracket, qs))).alias("_b"))
        .select(*keys, "_n", "_b.*")
        .select(*[F.col(k).alias(f"b{k}") for k in keys], "_q", "_lo", "_hi", F.floor(at).alias("_k0"), F.ceil(at).alias("_k1"), (at - F.floor(at)).alias("_part")),
        "brackets",
    )
    same = [F.col(k).eqNullSafe(F.col(f"b{k}")) for k in keys]
    width = F.col("_hi") - F.col("_lo")
    cell = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), CELLS).when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("_v") - F.col("_lo")) / F.when(width > 0, width) * CELLS).cast("int"))).otherwise(0)
    joined = rows.join(brackets, same) if keys else rows.crossJoin(brackets)  # a row per percentile
    group = [f"b{k}" for k in keys] + ["_q"]
    fixed = ["_lo", "_hi", "_k0", "_k1", "_part"]
    counted = joined.groupBy(*group, *fixed, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS + 2 rows
    cells = counted.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).where((F.col("_before") <= F.col("_k1")) & (F.col("_before") + F.col("_c") > F.col("_k0")))
    names = [F.col(c).alias(f"c{c}") for c in (*group, "_cell", "_before")]
    hit = [F.col(g).eqNullSafe(F.col(f"c{g}")) for g in group] + [F.col("_at") == F.col("c_cell")]
    inside = joined.withColumn("_at", cell).join(cells.select(*names), hit).groupBy(*group, *fixed, "_at", F.col("c_before").alias("_before"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    v = Window.partitionBy(*group, "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # the values of one cell
    placed = inside.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(v), F.lit(0)))
    holds = lambda k: (F.col("_from") <= F.col(k)) & (F.col("_from") + F.col("_c") > F.col(k))
    ends = placed.groupBy(*group, "_part").agg(F.max(F.when(holds("_k0"), F.col("_v"))).alias("_a"), F.max(F.when(holds("_k1"), F.col("_v"))).alias("_b"))
    return ends.select(*[F.col(f"b{k}").alias(c) for k, c in zip(keys, by, strict=True)], F.col("_q").alias("q"), (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("value"))


def widened(quantiles: DataFrame, by: list[str], names: dict[float, str], digits: int) -> DataFrame:
    """One column per percentile of exact_quantiles, rounded."""
    pick = [F.round(F.max(F.when(F.col("q") == q, F.col("value"))), digits).alias(name) for q, name in names.items()]
    return (quantiles.groupBy(*by) if by else quantiles.groupBy()).agg(*pick)


def joined_quantiles(summary: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """summary with the columns of quantiles; group keys may be null."""
    if not by:
        return summary.crossJoin(quantiles)  # one row each
    other = quantiles.withColumnsRenamed({c: f"_{c}" for c in by})
    return summary.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])

