"""The k most similar vectors of every vector.

Vectors are projected onto a few random directions drawn from the normal (a
2-stable) law, so a projected distance over the true one follows a chi law. A
kd-tree over the projections has its upper levels as Spark partitions (regions)
and its lower levels inside each task. A vector visits the cells that can hold a
vector within reach, nearest first; projected neighbours are verified until a
chi-square test says that the rest is too far, with a stated chance of a miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import drawn, stored

#: Vectors that fit the region tree: a bounded sample; every vector is indexed.
SAMPLE = 20_000
#: Tasks that the members of one group of equal vectors are spread over.
SALTS = 16
#: Buckets of ids whose vectors may be needed once more: a bounded table that goes to every task.
BUCKETS = 1 << 20
#: Error of a cosine of two coded vectors, with room to spare: 16-bit numbers scaled by a vector's largest one are off by 1.5e-5 of it at most.
CODE_ERROR = 5e-5
#: (row, cell) pairs looked at in one step, at most: bounds the memory of the way down a deep tree.
CELLS = 1 << 22


@dataclass(frozen=True)
class Settings:
    """length: numbers per vector. dims: projections that the chi-square test compares. region_rows: vectors whose home is one region. visitors: vectors that visit one task's copy of a region, more take turns in further copies. miss: chance that the cells visited leave out a vector just within reach, at either tree level. chi_miss: the same for the stopping test."""

    k: int = 5
    min_similarity: float = -1.0
    length: int = 64
    dims: int = 16
    region_rows: int = 40_000
    visitors: int = 120_000
    leaf_rows: int = 128
    miss: float = 0.04
    chi_miss: float = 0.02
    seed: int = 11

    @property
    def reach(self) -> float:
        """The largest distance of unit vectors that counts."""
        return math.sqrt(max(1e-6, 2 - 2 * self.min_similarity))

    def directions(self, n: int | None = None) -> np.ndarray:
        """n projections, of which the first are the same for every n."""
        return np.random.default_rng(self.seed).standard_normal((max(n or 0, self.dims), self.length)).astype(np.float32).T


def chi_square_quantile(p: float, df: int) -> float:
    """Wilson and Hilferty's approximation, good to 1 % for df >= 3."""
    from statistics import NormalDist

    return df * (1 - 2 / (9 * df) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * df))) ** 3


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Zelen and Severo's approximation (fixed values), error below 1e-5."""
    t = 1 / (1 + np.float32(0.33267) * np.abs(x))
    tail = np.exp(np.float32(-0.5) * x * x) * (t * np.float32(0.3989423)) * (np.float32(0.4361836) + t * (np.float32(-0.1201676) + t * np.float32(0.9372980)))
    return np.where(x > 0, 1 - tail, tail)


# The kd-tree: level l splits on projected direction first + l at the median of each node; thresholds are kept level by level.


def fit_tree(points: np.ndarray, depth: int, first: int = 0) -> list[np.ndarray]:
    node, levels = np.zeros(len(points), dtype=np.int64), []
    for level in range(depth):
        y = points[:, first + level]
        order = np.lexsort((y, node))
        counts = np.bincount(node, minlength=1 << level)
        ends = np.cumsum(counts)
        middle = np.minimum(ends - counts + counts // 2, max(0, len(points) - 1))
        cut = np.where(counts > 0, y[order][middle] if len(points) else 0.0, 0.0).astype(np.float32)
        levels.append(cut)
        node = node * 2 + (y > cut[node])
    return levels


def leaf_of(levels: list[np.ndarray], points: np.ndarray, first: int = 0) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    for level, cut in enumerate(levels):
        node = node * 2 + (points[:, first + level] > cut[node])
    return node


def visited(levels: list[np.ndarray], points: np.ndarray, reach: np.ndarray, miss: float, first: int = 0, node_reach: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs: per row the likeliest leaves that hold all but ``miss`` of the chance mass of a vector at distance reach.

    A vector at distance r differs by N(0, r^2) on each direction, independently,
    so the mass of a leaf is a product over the levels. node_reach[l] may raise the
    reach below nodes of level l whose own vectors still look further. Unlikely
    branches are cut on the way; rows that lose more than miss by that go down again
    with a lower bound, at last miss / 2**levels, where all cuts together stay within miss.
    """
    finest = miss / (1 << len(levels))
    size = max(1, CELLS >> len(levels))
    out = [(np.empty(0, dtype=np.int64),) * 2]
    for start in range(0, len(points), size):
        rows, least = np.arange(start, min(start + size, len(points))), max(finest, miss / 400)
        while len(rows):
            at, leaves, enough = _descend(levels, points[rows], reach[rows], miss, least, first, node_reach)
            if least > finest:
                done = enough[at]
                out.append((rows[at[done]], leaves[done]))
                rows, least = rows[~enough], max(finest, least / 8)
            else:
                out.append((rows[at], leaves))
                break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _descend(levels: list[np.ndarray], points: np.ndarray, reach: np.ndarray, miss: float, least: float, first: int, node_reach: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One way down without branches below ``least``: (row, leaf) pairs, and which rows have all but ``miss`` of their mass in them."""
    rows, node, mass = np.arange(len(points), dtype=np.int32), np.zeros(len(points), dtype=np.int32), np.ones(len(points), dtype=np.float32)
    least, reach = np.float32(least), np.maximum(reach, np.float32(1e-6))
    for level, cut in enumerate(levels):
        r = reach[rows] if node_reach is None else np.maximum(reach[rows], node_reach[level][node])
        lower = mass * _normal_cdf((cut[node] - np.ascontiguousarray(points[:, first + level])[rows]) / r)
        upper = mass - lower
        a, b = np.flatnonzero(lower > least), np.flatnonzero(upper > least)
        rows, node, mass = np.concatenate((rows[a], rows[b])), np.concatenate((node[a] * 2, node[b] * 2 + 1)), np.concatenate((lower[a], upper[b]))
    order = np.argsort(rows - np.minimum(mass, np.float32(1 - 1e-6)).astype(np.float64))  # by row, and from the likeliest down
    rows, node, mass = rows[order].astype(np.int64), node[order].astype(np.int64), mass[order]
    total = np.cumsum(mass, dtype=np.float64)
    sums = np.bincount(rows, weights=mass, minlength=len(points))
    before = total - mass - (np.cumsum(sums) - sums)[rows]
    keep = before < 1 - miss
    return rows[keep], node[keep], sums >= 1 - miss


#: Cells of a vector that are looked at before its reach is set anew: the likeliest four, then the rest.
STEPS = (0, 4, 1 << 30)
#: Asking vectors that are looked after together.
BLOCK = 16_384


def search_region(units: np.ndarray, names: np.ndarray, home: np.ndarray, s: Settings, first: int, ask_home: bool = True, among: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed edges (of, to, cosine) among one region's vectors, at most k of each ``of``.

    home marks the indexed vectors; the others only visit. With ask_home, home
    vectors look for neighbours too: among visiting vectors, and with ``among`` also
    among each other. A vector looks at its own cell and then at the likeliest ones in
    turn; its reach falls to the distance of its k-th neighbour so far, and projected
    neighbours that the chi-square test rules out at that reach aren't verified.
    """
    depth = max(0, int(math.log2(max(1, home.sum()) / s.leaf_rows)) if home.sum() > s.leaf_rows else 0)
    all_proj = units @ s.directions(first + depth)
    proj = all_proj[:, : s.dims]
    rank = np.unique(names, return_inverse=True)[1]  # equal for the visiting and the indexed copy of one vector
    at_home, k, reach0 = np.flatnonzero(home), s.k, s.reach
    chi = chi_square_quantile(1 - s.chi_miss, s.dims)
    levels = fit_tree(all_proj[at_home], depth, first)
    own_leaf = leaf_of(levels, all_proj, first)
    home_leaf = own_leaf[at_home]
    order = np.argsort(home_leaf, kind="stable")
    members, bounds = at_home[order], np.searchsorted(home_leaf[order], np.arange((1 << depth) + 1))
    square, one = (proj * proj).sum(1)[:, None], np.ones((len(proj), 1), dtype=np.float32)
    left, right = np.hstack((-2 * proj, square, one)), np.hstack((proj, one, square))  # left @ right is the squared distance
    reach = np.full(len(units), reach0, dtype=np.float32)  # falls to the distance of the k-th neighbour found so far
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))

    def against(rows: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified neighbours of the rows in the cells given; with ask_home also what they are to home vectors."""
        found = [none]
        order = np.argsort(leaves.astype(np.uint16) if depth <= 16 else leaves, kind="stable")  # short numbers sort by their digits
        rows, leaves = rows[order], leaves[order]
        for part, leaf in zip(np.split(rows, np.flatnonzero(np.diff(leaves)) + 1), leaves[np.flatnonzero(np.r_[True, np.diff(leaves) > 0])] if len(leaves) else (), strict=False):
            there = members[bounds[leaf] : bounds[leaf + 1]]
            if not len(there):
                continue
            d = (left[part] @ right[there].T).ravel()
            most = reach[part].max() if not ask_home else max(reach[part].max(), reach[there].max())
            at = np.flatnonzero(d <= most * most * chi + 1e-4)
            a, b = part[at // len(there)], there[at % len(there)]
            limit = reach[a] if not ask_home else np.maximum(reach[a], reach[b])
            different = (rank[a] != rank[b]) & (d[at] <= limit * limit * chi + 1e-4)
            a, b = a[different], b[different]
            cos = np.einsum("ij,ij->i", units[a], units[b])
            near = cos >= s.min_similarity - CODE_ERROR
            found.append((a[near], b[near], cos[near]))
        of, to, cos = map(np.concatenate, zip(*found, strict=True))
        if ask_home:
            back = home[to]
            of, to, cos = np.r_[of, to[back]], np.r_[to, of[back]], np.r_[cos, cos[back]]
        return of, to, cos

    def best(of: np.ndarray, to: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest names of each ``of`` (one more, as codes are rounded); ties go to the smaller name; the same pair counts once."""
        if not len(of):
            return of, to, cos
        order = np.lexsort((rank[to], -np.round(cos, 6), of))
        of, to, cos = of[order], to[order], cos[order]
        fresh = np.r_[True, (of[1:] != of[:-1]) | (to[1:] != to[:-1])]
        of, to, cos = of[fresh], to[fresh], cos[fresh]
        keep = np.arange(len(of)) - np.searchsorted(of, of, side="left") < k + 1
        return of[keep], to[keep], cos[keep]

    def settle(of: np.ndarray, cos: np.ndarray) -> None:
        """Sets the reach of vectors with k neighbours to the distance of the k-th. of is in order, cos falls inside each."""
        kth = np.arange(len(of)) - np.searchsorted(of, of, side="left") == k - 1
        reach[of[kth]] = np.minimum(reach[of[kth]], np.sqrt(np.maximum(0, 2 - 2 * cos[kth]))).astype(np.float32)

    asking = np.arange(len(units)) if ask_home and among else np.flatnonzero(~home)
    # First the own cell: it fixes how far each vector still has to look.
    edges = [best(*against(asking, own_leaf[asking]))]
    settle(edges[0][0], edges[0][2])
    for start in range(0, len(asking), BLOCK):
        rows = asking[start : start + BLOCK]
        node_reach = None
        if ask_home and depth:  # a cell is also visited for its own vectors that still look further
            leaf_reach = np.zeros(1 << depth, dtype=np.float32)
            np.maximum.at(leaf_reach, home_leaf, reach[at_home])
            node_reach = [leaf_reach.reshape(-1, 2).max(1)]
            while len(node_reach[0]) > 1:
                node_reach.insert(0, node_reach[0].reshape(-1, 2).max(1))
        r, leaves = visited(levels, all_proj[rows], reach[rows], s.miss, first, node_reach)
        turn = _turns(r)
        of, to, cos = edges[0]
        mine = slice(np.searchsorted(of, rows[0]), np.searchsorted(of, rows[-1], side="right"))
        block = (of[mine], to[mine], cos[mine])
        other = leaves != own_leaf[rows[r]]
        for low, high in zip(STEPS, STEPS[1:], strict=False):
            now = other & (turn >= low) & (turn < high)
            if now.any():
                block = best(*map(np.concatenate, zip(block, against(rows[r[now]], leaves[now]), strict=True)))
                settle(block[0], block[2])
        edges.append(block)
    return best(*map(np.concatenate, zip(*edges, strict=True)))


def _turns(rows: np.ndarray) -> np.ndarray:
    """The how-manyth of its row each entry is."""
    if (np.diff(rows) >= 0).all():
        return np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    order = np.argsort(rows, kind="stable")
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order], side="left")
    return out


def coded(units: np.ndarray) -> list[bytes]:
    """Vectors as 16-bit numbers scaled by the largest one."""
    scale = 32767 / np.maximum(np.abs(units).max(1, keepdims=True), 1e-30)
    return [x.tobytes() for x in np.rint(units * scale).astype(np.int16)]


def decoded(codes: list[bytes], length: int) -> np.ndarray:
    """Unit vectors of codes; the scale doesn't matter."""
    units = np.frombuffer(b"".join(codes), dtype=np.int16).reshape(len(codes), length).astype(np.float32)
    return units / np.linalg.norm(units, axis=1, keepdims=True)


def _goes(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of two regions whose vectors may meet, one visits the other: which one alternates over the pairs, so that no region gets all the visitors."""
    low, high = np.minimum(own, other), np.maximum(own, other)
    return (own != other) & ((own < other) == ((((low + 1) * 2654435761 ^ (high + 1) * 40503 * 65537) >> 13) % 2 == 0))


def unit_rows(vectors: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and those as unit vectors. Null, of another length, all zero, NaN and infinite ones are not usable."""
    right = vectors.map(lambda v: v is not None and len(v) == length).to_numpy(dtype=bool)
    if not right.any():
        return np.zeros(len(vectors), bool), np.empty((0, length), np.float32)
    x = np.stack(vectors[right].to_list()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    ok = right.copy()
    ok[right] = good
    return ok, (x[good] / norm[good, None]).astype(np.float32)


def _usable(df: DataFrame, id_col: str, vector_col: str, s: Settings) -> DataFrame:
    """id, v and a code that is equal for equal vectors; only usable vectors."""
    v = F.col(vector_col)
    low, high, limit = F.array_min(v), F.array_max(v), F.lit(float("inf"))
    # NaN counts as larger than infinity here
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == s.length) & (F.size(F.array_compact(v)) == s.length)
    return df.where(usable & (high < limit) & (low > -limit) & ((high != 0) | (low != 0))).select(F.col(id_col).alias("id"), v.alias("v"), F.xxhash64(v).alias("code"))


def _heads(ids: pd.Series, codes: pd.Series, k: int) -> np.ndarray:
    """Positions of the first k + 1 ids of each group of equal vectors in a batch; more of them can't be anyone's neighbours."""
    frame = pd.DataFrame({"id": ids, "code": codes})
    again = frame["code"].duplicated(keep=False)
    if not again.any():
        return frame.index.to_numpy()
    some = frame[again].drop_duplicates().sort_values("id")
    return np.concatenate((frame.index[~again], some.index[some.groupby("code", sort=False).cumcount() <= k]))


@dataclass(frozen=True)
class Regions:
    """The upper levels of the tree, and into how many copies each region's visitors are dealt."""

    levels: list[np.ndarray]
    copies: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.levels)


def _regions(vectors: DataFrame, asked: DataFrame | None, s: Settings) -> Regions:
    """Fitted on at most SAMPLE different vectors brought to the driver; so is the number of visitors that each region will have."""
    n = vectors.count()
    depth = max(0, math.ceil(math.log2(max(1, n / s.region_rows))))
    if not depth:
        return Regions([], np.ones(1, dtype=np.int64))
    _, units = unit_rows(drawn(vectors.select("v"), SAMPLE, n, s.seed).toPandas()["v"], s.length)
    proj = units @ s.directions(depth)
    levels = fit_tree(proj, depth)
    some = proj[: SAMPLE // 10]
    r, leaves = visited(levels, some, np.full(len(some), s.reach, dtype=np.float32), s.miss)
    own = leaf_of(levels, some)
    goes = _goes(own[r], leaves) if asked is None else leaves >= 0
    each = (n if asked is None else asked.count()) / max(1, len(some))
    visitors = np.bincount(leaves[goes], minlength=1 << depth) * each
    return Regions(levels, np.maximum(1, np.ceil(visitors / s.visitors)).astype(np.int64))


def nearest(vectors: DataFrame, id_col: str, vector_col: str, s: Settings, queries: DataFrame | None = None) -> DataFrame:
    """The k most similar other vectors of every vector, or of the rows of queries: id, neighbour, similarity (cosine), rank.

    Vectors that are null, of another length, all zero or not finite take no part.
    A repeated id with the same vector counts once. Equal similarities go to the
    smaller neighbour id. Of equal vectors only the
    first k + 1 ids can be neighbours of others in that group or elsewhere; the rest
    of such a group gets its neighbours from those by a join, so a huge group of
    copies costs no pairs. With min_similarity, less similar ones are left out.
    Empty input gives no rows.

    Plan: each vector goes to its home region once and, as a visitor, to other
    regions that can hold a vector within reach. With a minimum similarity the reach
    is known, so of each pair of regions one visits the other, and a meeting serves
    both vectors. Without one, a first round inside the home region tells how far each
    vector has to look, and in a second it visits the regions within that. The visitors
    of a region are dealt to as many copies of it as keep each task bounded. Vectors
    travel as 16-bit codes; similarities close to the minimum are taken from the
    vectors themselves. The last shuffle moves at most k + 1 rows per vector and region.
    """
    base = _usable(vectors, id_col, vector_col, s)
    asked = _usable(queries, id_col, vector_col, s) if queries is not None else None
    if s.min_similarity > -1:
        edges = _search(base, asked, s, _regions(base, asked, s))
        edges = _checked(stored(edges, "edges"), base, asked, s)
    else:
        edges = _two_rounds(base, asked if asked is not None else base, s)
    if asked is None:
        edges = edges.unionByName(_copies_beyond(base, s))
    w = Window.partitionBy("id").orderBy(F.round("similarity", 6).desc(), "neighbour")
    return edges.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.k)


def _search(base: DataFrame, asked: DataFrame | None, s: Settings, regions: Regions, own_only: bool = False) -> DataFrame:
    """Edges id, neighbour, similarity found in the regions. asked may hold a column reach of its own; own_only: its vectors visit their own region alone."""
    id_type = base.schema["id"].dataType.simpleString()
    levels, depth, copies, ask_home = regions.levels, regions.depth, regions.copies, asked is None

    def place(batches: Iterator[pd.DataFrame], at_home: bool, visiting: bool) -> Iterator[pd.DataFrame]:
        directions = s.directions(depth)
        for pdf in batches:
            if at_home:
                pdf = pdf.iloc[_heads(pdf["id"], pdf["code"], s.k)]
            ok, units = unit_rows(pdf["v"], s.length)
            ids = pdf["id"][ok].reset_index(drop=True)
            reach = np.full(len(units), s.reach, dtype=np.float32) if "reach" not in pdf else pdf["reach"][ok].to_numpy(dtype=np.float32)
            proj = units @ directions
            own = leaf_of(levels, proj)
            codes = pd.Series(coded(units), dtype=object)
            if at_home:  # a row for every copy of the region
                n = copies[own]
                rows = np.repeat(np.arange(len(own)), n)
                turn = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"region": own[rows], "copy": turn, "home": True, "id": ids.iloc[rows].to_numpy(), "unit": codes.iloc[rows].to_numpy()})
            if visiting and (depth or not at_home):
                step = max(1, CELLS // 4 >> min(depth, 20))  # a deep tree may send a vector to thousands of regions
                for start in range(0, len(units), step):
                    part = slice(start, start + step)
                    rows, leaves = (np.arange(len(own[part])), own[part]) if own_only else visited(levels, proj[part], reach[part], s.miss)
                    rows = rows + start
                    go = _goes(own[rows], leaves) if at_home else (leaves == own[rows]) == own_only if "reach" in pdf or own_only else leaves >= 0
                    rows, leaves = rows[go], leaves[go]
                    turn = pd.util.hash_array(ids.iloc[rows].to_numpy()).astype(np.uint64) % copies[leaves].astype(np.uint64)
                    yield pd.DataFrame({"region": leaves, "copy": turn.astype(np.int64), "home": False, "id": ids.iloc[rows].to_numpy(), "unit": codes.iloc[rows].to_numpy()})

    schema = f"region bigint, copy bigint, home boolean, id {id_type}, unit binary"
    placed = base.mapInPandas(lambda b: place(b, True, ask_home), schema)
    if asked is not None:
        placed = placed.unionByName(asked.mapInPandas(lambda b: place(b, False, True), schema))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "home"])
        names, home = pdf["id"].to_numpy(), pdf["home"].to_numpy(dtype=bool)
        if len(pdf) < 2 or not home.any():
            return pd.DataFrame({"id": names[:0], "neighbour": names[:0], "similarity": np.empty(0)})
        of, to, cos = search_region(decoded(pdf["unit"].tolist(), s.length), names, home, s, depth, ask_home, key[1] == 0)
        return pd.DataFrame({"id": names[of], "neighbour": names[to], "similarity": np.clip(cos, -1, 1).astype(np.float64)})

    edges = placed.groupBy("region", "copy").applyInPandas(search, f"id {id_type}, neighbour {id_type}, similarity double")
    return edges.where(F.col("id") != F.col("neighbour"))


def _two_rounds(base: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """First the home region of every asked vector, then the other regions within the distance of its k-th neighbour there."""
    regions = _regions(base, asked, s)
    if not regions.depth:
        return _search(base, asked, s, regions, own_only=True)
    near = stored(_search(base, asked, s, Regions(regions.levels, np.ones_like(regions.copies)), own_only=True), "near")
    w = Window.partitionBy("id").orderBy(F.col("similarity").desc())
    kth = near.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == s.k).select(F.col("id").alias("_id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).cast("float").alias("_kth"))
    further = asked.join(kth, F.col("id") == F.col("_id"), "left").select("id", "v", "code", F.coalesce("_kth", F.lit(s.reach).cast("float")).alias("reach"))
    return near.unionByName(_search(base, further, s, regions))


def _checked(edges: DataFrame, base: DataFrame, asked: DataFrame | None, s: Settings) -> DataFrame:
    """edges (read several times) without those below the minimum; similarities that the codes leave open are taken from the vectors."""
    open_ = edges.where(F.abs(F.col("similarity") - s.min_similarity) <= CODE_ERROR)
    sure = edges.where(F.col("similarity") > s.min_similarity + CODE_ERROR)
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
    wanted = F.broadcast(open_.select(F.explode(F.array("id", "neighbour")).alias("id")).select(bucket.alias("_b")).distinct())  # at most BUCKETS numbers
    every = base if asked is None else base.unionByName(asked.select(*base.columns))
    known = every.withColumn("_b", bucket).join(wanted, "_b", "left_semi").select("id", "v").dropDuplicates(["id"])
    one, other = (known.select(F.col("id").alias(n), F.col("v").alias(v)) for n, v in (("id", "_v"), ("neighbour", "_w")))

    def cosines(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pairs:
            x, y = (np.stack(pdf[c].to_list()).astype(np.float64) if len(pdf) else np.empty((0, s.length)) for c in ("_v", "_w"))
            cos = (x * y).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-300)
            yield pd.DataFrame({"id": pdf["id"], "neighbour": pdf["neighbour"], "similarity": np.clip(cos, -1, 1)})

    exact = open_.select("id", "neighbour").distinct().join(one, "id").join(other, "neighbour").mapInPandas(cosines, edges.schema)
    return sure.unionByName(exact.where(F.col("similarity") >= s.min_similarity))


def _copies_beyond(base: DataFrame, s: Settings) -> DataFrame:
    """Neighbours of the members of a group of equal vectors that come after its first k + 1 ids; the members of a large group are spread over SALTS tasks."""
    members = base.select("code", "id").distinct()
    large = members.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.k + 1).select("code")
    parts = members.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_large = parts.join(salted, ["code", "_salt"])
    w, all_ = Window.partitionBy("code", "_salt").orderBy("id"), Window.partitionBy("code").orderBy("id")
    heads = of_large.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= s.k + 1).withColumn("rn", F.row_number().over(all_)).where(F.col("rn") <= s.k + 1)
    lists = heads.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("heads")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    beyond = of_large.join(lists, ["code", "_salt"]).where(~F.array_contains("heads", F.col("id")))
    return beyond.select("id", F.explode(F.slice("heads", 1, s.k)).alias("neighbour"), F.lit(1.0).alias("similarity"))


def similar_pairs(neighbours: DataFrame, min_similarity: float) -> DataFrame:
    """Distinct pairs (id_a < id_b) of which one is among the other's neighbours."""
    near = neighbours.where(F.col("similarity") >= min_similarity)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
