import numpy as np

from siltstone.llm import percentiles as P


def rank_of(values, x):
    return np.searchsorted(np.sort(values), x, side="right") / len(values)


def test_error_bound_and_merge(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate((rng.lognormal(5, 2, 20000), rng.normal(100, 1, 10000)))
    rows = [("a", int(i % 7), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(8)
    days = P.sketches(df, ["g", "day"], "v", 400)
    r = P.percentiles(P.merged(days, ["g"], 400), (0.5, 0.95), 400).first()
    assert r["n"] == len(values)
    for q, name in ((0.5, "p50"), (0.95, "p95")):
        assert abs(rank_of(values, r[name]) - q) < 2 * P.rank_error(400)
        assert r[name + "_low"] <= r[name] <= r[name + "_high"]


def test_groups_above_is_exact_near_the_threshold(spark):
    rows = []
    for g in range(30):
        n = 40 + g
        rows += [(f"g{g}", float(3000 + (i - 0.95 * (n - 1)) + (g - 15) * 0.01)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = set()
    for g in range(30):
        v = [x for n, x in rows if n == f"g{g}"]
        if np.quantile(v, 0.95) > 3000:
            want.add(f"g{g}")
    for k in (8, 1600):
        assert {r["g"] for r in P.groups_above(df, ["g"], "v", 0.95, 3000.0, k).collect()} == want


def test_left_out_values_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 5000.0), (None, None), ("a", float("nan")), ("a", -1.0), ("b", 5000.0), ("b", -5.0)], "g string, v double")
    assert {r["g"] for r in P.groups_above(df, ["g"], "v", 0.95, 3000.0).collect()} == {None, "b"}
    assert P.groups_above(df.limit(0), ["g"], "v", 0.95, 3000.0).count() == 0
    assert P.sketches(df.where("g = 'a'"), ["g"], "v", least=0.0).count() == 0


def test_once(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, 1, "x"), (1, 1, "x")], "a int, b int, _h1 string").select("a", "b")
    assert P.once(df, "a").count() == 3


def test_negative_values_count_unless_left_out(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(-50, 51)] + [("a", float("nan")), ("a", None)], "g string, v double")
    assert P.sketches(df, ["g"], "v").first()["n"] == 101 and P.sketches(df, ["g"], "v", least=0.0).first()["n"] == 51
    assert P.percentiles(P.sketches(df, ["g"], "v"), (0.5,)).first()["p50"] == 0.0
    assert P.groups_above(df, ["g"], "v", 0.5, -0.5).count() == 1 and P.groups_above(df, ["g"], "v", 0.5, 0.0).count() == 0
