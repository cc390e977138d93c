"""Vector expressions over ARRAY<DOUBLE> (other numeric arrays are cast)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    v = a.cast("array<double>")
    # the length stands in a struct, so that it is computed once and not for every element
    once = F.transform(F.transform(F.array(v), lambda v: F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.when(s["n"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))
    return once[0]


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero and unequally long vectors."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    scale = norm(a) * norm(b)
    return F.coalesce(F.when(fits & (scale > 0), dot(a, b) / F.when(scale > 0, scale)), F.lit(0.0))


def inverse_distance(distance: Column) -> Column:
    """1 / (1 + distance), negative distances counting as 0."""
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), distance))


def complement(distance: Column) -> Column:
    """1 - distance, at least 0."""
    return F.greatest(F.lit(0.0), 1.0 - distance)


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic unit vector of a text, for tests without a model: a linear congruential sequence seeded by md5.

    Fixed values: multiplier 1664525 and increment 1013904223 modulo 2^32. Only the
    low 32 bits of the digest matter.
    """
    seed = F.conv(F.substring(F.md5(text), 25, 8), 16, 10).cast("bigint")
    state = F.struct(seed.alias("s"), F.array().cast("array<double>").alias("v"))

    def step(acc: Column, _: Column) -> Column:
        s = (acc["s"] * 1664525 + 1013904223) % (1 << 32)
        return F.struct(s.alias("s"), F.concat(acc["v"], F.array(s / F.lit(4294967295.0) * 2 - 1)).alias("v"))

    return l2_normalize(F.aggregate(F.sequence(F.lit(1), F.lit(dim)), state, step, lambda acc: acc["v"]))
