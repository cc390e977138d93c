"""Percentiles of very large numeric columns by mergeable compactor sketches.

A KLL sketch is a hierarchy of compactors: a full level is sorted, every other
value (odd or even by a coin toss) moves up with twice the weight, and sketches
merge level by level. Spark builds and merges them inside the JVM, partially
before the shuffle, so a group moves a few KB per task however many rows it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import stored

#: Size of the top compactor. The rank error falls about as 1/K.
K = 1600


def rank_error(k: int = K) -> float:
    """Rank error (as a share of n) of one percentile that holds with a probability of 99 %.

    Fixed value: the published fit 2.296 / k^0.9021 for this sketch.
    """
    return 2.296 / math.pow(k, 0.9021)


def once(df: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of df's distinct rows. Rows meet by two 64-bit hashes of all columns, so the shuffle moves neither wide rows nor strings."""
    cols = sorted(c for c, t in df.dtypes if not t.startswith("map"))
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in cols])
    hashed = df.select(*keep, F.xxhash64(nulls, *[F.col(f"`{c}`") for c in cols]).alias("_h1"), F.xxhash64(*[F.col(f"`{c}`") for c in reversed(cols)], nulls).alias("_h2"))
    return hashed.dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")


def usable(value: Column, least: float | None = None) -> Column:
    """Null and NaN are left out, and so is what lies below least, if that is given."""
    known = value.isNotNull() & ~F.isnan(value)
    return known if least is None else known & (value >= least)


def sketches(df: DataFrame, by: list[str], value: str, k: int = K, least: float | None = None) -> DataFrame:
    """One sketch per group: by, sketch (BINARY), n. Values that are null, NaN or below least are left out; a group without usable values has no row."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(usable(F.col("_v"), least))
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double("_v", k).alias("sketch")).withColumn("n", F.kll_sketch_get_n_double("sketch"))


def merged(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Combines sketches of separate partitions or days into those of coarser groups; the bound stays that of a single sketch of size k."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch")).withColumn("n", F.kll_sketch_get_n_double("sketch"))


def percentiles(parts: DataFrame, qs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), k: int = K) -> DataFrame:
    """Adds pXX with pXX_low and pXX_high (values at the ranks q -/+ error) and rank_error; drops the sketch."""
    e = rank_error(k)
    for q in qs:
        name = f"p{q * 100:g}".replace(".", "_")
        for suffix, at in (("", q), ("_low", max(0.0, q - e)), ("_high", min(1.0, q + e))):
            parts = parts.withColumn(name + suffix, F.kll_sketch_get_quantile_double("sketch", F.lit(at)))
    return parts.withColumn("rank_error", F.lit(e)).drop("sketch")


def groups_above(df: DataFrame, by: list[str], value: str, q: float, threshold: float, k: int = K, least: float | None = None) -> DataFrame:
    """Groups whose exact q-th percentile (linear interpolation) exceeds threshold.

    The threshold's rank in the sketch decides most groups; those whose rank is
    within the error of q get an exact check, which needs only counts and the two values next
    to the threshold, never the group's rows in one place. Sketches toss coins, so the
    ranks (a row per group) are kept: both decisions rest on the same ones. Group keys may
    be null.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(usable(F.col("_v"), least))
    e = rank_error(k)
    # the share of values up to the threshold, within the sketch's error and the rank that interpolation may add
    slack = F.lit(2 * e) + 1.5 / F.col("n")
    ranks = stored(sketches(rows, by, "_v", k).select(*by, F.kll_sketch_get_rank_double("sketch", F.lit(float(threshold))).alias("_rank"), slack.alias("_slack")), "ranks")
    sure = ranks.where(F.col("_rank") < q - F.col("_slack")).select(*by)
    open_ = ranks.where(F.abs(F.col("_rank") - q) <= F.col("_slack")).select(*[F.col(c).alias(f"_{c}") for c in by])
    same = [rows[c].eqNullSafe(open_[f"_{c}"]) for c in by]
    below, above = F.when(F.col("_v") <= threshold, F.col("_v")), F.when(F.col("_v") > threshold, F.col("_v"))
    at = (F.col("n") - 1) * F.lit(q)
    exact = (
        rows.join(open_, same, "left_semi")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.count(below).alias("_c"), F.max(below).alias("_lo"), F.min(above).alias("_hi"))
        .where((F.col("_c") <= F.floor(at)) | ((F.col("_c") == F.floor(at) + 1) & (F.col("_lo") + (at - F.floor(at)) * (F.col("_hi") - F.col("_lo")) > threshold)))
        .select(*by)
    )
    return sure.unionByName(exact)


def held_bounds(df: DataFrame, estimates: DataFrame, by: list[str], value: str, qs: tuple[float, ...], error: float, least: float | None = None) -> DataFrame:
    """Per group: n, and for each percentile of estimates (columns pXX) whether its true rank among df's values is within error of q.

    A check by counts: the estimates (a row per group) meet the rows, which are summed
    before they move. The rank of a value that repeats is any of its places.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(usable(F.col("_v"), least))
    names = [f"p{q * 100:g}".replace(".", "_") for q in qs]
    known = estimates.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(x).alias(f"_{x}") for x in names])
    joined = rows.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    counts = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_v") < F.col(f"_{x}")).alias(f"_lo_{x}") for x in names], *[F.count_if(F.col("_v") <= F.col(f"_{x}")).alias(f"_hi_{x}") for x in names])
    inside = [((F.col(f"_lo_{x}") / F.col("n") <= q + error) & (F.col(f"_hi_{x}") / F.col("n") >= q - error)).alias(f"{x}_holds") for q, x in zip(qs, names, strict=True)]
    return counts.select(*by, "n", *inside)
