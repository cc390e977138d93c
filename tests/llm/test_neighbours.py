import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import neighbours as nb


def planted(n, copies, seed=1, dim=64):
    """n random vectors, and near copies of the first ones."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    near = x[:copies] + 0.25 * rng.standard_normal((copies, dim))
    return np.vstack((x, near)).astype(np.float32)


def frame(spark, x, ids=None):
    rows = [(f"v{i:05d}" if ids is None else ids[i], [float(a) for a in v], "clash", i) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, embedding array<float>, neighbour string, rank int")


def brute(x, k, least=-1.0):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}


def test_pairs_within_reach_across_regions(spark):
    x = planted(3000, 400)
    s = nb.Settings(k=5, min_similarity=0.85, region_rows=500)
    got = nb.nearest(frame(spark, x), "id", "embedding", s)
    pairs = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in got.collect()}
    want = brute(x, 5, 0.85)
    assert len(pairs & want) >= 0.97 * len(want) and pairs <= want


def test_general_recall(spark):
    x = planted(2000, 0)
    s = nb.Settings(k=10)
    of, to, _ = nb.search_region((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32), np.arange(len(x)), np.ones(len(x), bool), s, 0)
    want = brute(x, 10)
    assert len({(int(a), int(b)) for a, b in zip(of, to, strict=True)} & want) >= 0.9 * len(want)


def test_queries_against_all(spark):
    x = planted(600, 100)
    df = frame(spark, x)
    got = nb.nearest(df, "id", "embedding", nb.Settings(k=3), df.where(F.col("rank") % 50 == 0)).collect()
    want = {p for p in brute(x, 3) if p[0] % 50 == 0}
    have = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in got}
    assert len(got) == 14 * 3 and len(have & want) >= 0.9 * len(want)


def test_bad_vectors_copies_and_ties(spark):
    e = [1.0] + [0.0] * 63
    rows = [(f"c{i}", e) for i in range(20)] + [("d", [-a for a in e]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64), ("short", [1.0]), ("null", None), (None, e), ("hole", [None] + e[1:]), ("c3", e), ("scaled", [2 * a for a in e])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = nb.nearest(df, "id", "embedding", nb.Settings(k=3, min_similarity=0.5))
    lists = {}
    for r in got.collect():
        lists.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert set(lists) == {f"c{i}" for i in range(20)} | {"scaled"}
    assert all(len(v) == 3 for v in lists.values())
    assert [n for _, n in sorted(lists["c19"])] == ["c0", "c1", "c10"] and [n for _, n in sorted(lists["c0"])] == ["c1", "c10", "c11"]
    assert nb.similar_pairs(got, 0.85).where("id_a >= id_b").count() == 0


def test_empty_and_single(spark):
    df = frame(spark, planted(1, 0))
    assert nb.nearest(df.limit(0), "id", "embedding", nb.Settings()).count() == 0
    assert nb.nearest(df, "id", "embedding", nb.Settings()).count() == 0


def test_chi_square():
    assert abs(nb.chi_square_quantile(0.98, 16) - 29.6) < 0.3


def test_visited_cells_hold_the_mass_at_every_depth():
    rng = np.random.default_rng(3)
    points = rng.standard_normal((1 << 15, 12)).astype(np.float32)
    for depth, reach, rows in ((7, 0.55, 400), (9, 2.0, 200), (12, 0.55, 200), (12, 2.0, 100)):
        levels, asked = nb.fit_tree(points, depth), points[:rows]
        r, leaves = nb.visited(levels, asked, np.full(rows, reach, dtype=np.float32), 0.04)
        others = asked[:, None, :] + reach * rng.standard_normal((rows, 200, 12)).astype(np.float32)
        there = nb.leaf_of(levels, others.reshape(-1, 12)).reshape(rows, 200)
        seen = np.zeros((rows, 1 << depth), dtype=bool)
        seen[r, leaves] = True
        assert len(r) == seen.sum() and seen[np.arange(rows)[:, None], there].mean() >= 0.955


def test_visited_is_the_same_in_small_steps(monkeypatch):
    points = np.random.default_rng(4).standard_normal((3000, 8)).astype(np.float32)
    levels, reach = nb.fit_tree(points, 8), np.full(300, 1.0, dtype=np.float32)
    want = set(zip(*map(np.ndarray.tolist, nb.visited(levels, points[:300], reach, 0.04)), strict=True))
    monkeypatch.setattr(nb, "CELLS", 1 << 10)
    assert set(zip(*map(np.ndarray.tolist, nb.visited(levels, points[:300], reach, 0.04)), strict=True)) == want
    none = nb.visited(levels, points[:0], reach[:0], 0.04)
    assert len(none[0]) == 0 and len(none[1]) == 0


def test_recall_with_many_region_levels(spark):
    x = planted(12000, 1500)
    near = nb.nearest(frame(spark, x), "id", "embedding", nb.Settings(k=5, min_similarity=0.85, region_rows=100)).collect()
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.85, 1))
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    have = {tuple(sorted((int(r["id"][1:]), int(r["neighbour"][1:])))) for r in near}
    assert len(have & want) >= 0.97 * len(want) and have <= want


def test_visitors_take_turns_in_copies(spark):
    x = planted(3000, 400)
    s = nb.Settings(k=5, min_similarity=0.85, region_rows=500, visitors=150)
    df = frame(spark, x)
    assert nb._regions(nb._usable(df, "id", "embedding", s), None, s).copies.max() > 1
    pairs = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in nb.nearest(df, "id", "embedding", s).collect()}
    want = brute(x, 5, 0.85)
    assert len(pairs & want) >= 0.97 * len(want) and pairs <= want


def test_general_recall_through_regions(spark):
    x = planted(4000, 0, seed=5)
    df = frame(spark, x)
    s = nb.Settings(k=10, region_rows=600, visitors=3000)
    every = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in nb.nearest(df, "id", "embedding", s).collect()}
    want = brute(x, 10)
    assert len(every) == 40_000 and len(every & want) >= 0.9 * len(want)
    some = {(int(r["id"][1:]), int(r["neighbour"][1:])) for r in nb.nearest(df, "id", "embedding", s, df.where(F.col("rank") % 50 == 0)).collect()}
    want = {p for p in want if p[0] % 50 == 0}
    assert len(some) == 800 and len(some & want) >= 0.9 * len(want)


def test_similarities_at_the_edge_are_exact(spark):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.85 + np.linspace(-4e-5, 4e-5, 400)[:, None]  # cosines that codes of 16 bits leave open
    x = np.vstack((a, c * a + np.sqrt(1 - c * c) * b)).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = {i for i in range(400) if u[i] @ u[400 + i] >= 0.85}
    got = {int(r["id"][1:]) for r in nb.nearest(frame(spark, x), "id", "embedding", nb.Settings(k=3, min_similarity=0.85)).collect() if int(r["id"][1:]) < 400}
    assert got <= want and len(got) >= 0.92 * len(want) and 150 < len(want) < 250  # what is missing was not visited
