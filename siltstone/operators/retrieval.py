"""Search and ranking: dense top-k, BM25, reciprocal rank fusion, hybrid search with a fallback, context building."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import split_tokens, token_set

#: Queries that go to every task at once, at most.
QUERY_BLOCK = 20_000
#: Scores (queries x documents) that a task holds at once.
TILE = 1 << 22


def default_k(k: int | None, default: int = 5) -> int:
    """The number of results asked for; 0 and None mean the default."""
    return k or default


def matches(metadata: Column, wanted: dict[str, str | None] | None) -> Column:
    """All key-value pairs are there; a wanted None also matches a missing key; no filter matches everything."""
    out = F.lit(True)
    for key, value in (wanted or {}).items():
        out = out & F.try_element_at(metadata, F.lit(key)).eqNullSafe(F.lit(value))
    return out


def top(ranked: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows per group with their rank from 1; ties (scores alike to 9 digits) go to the smaller tie column. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), tie)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best documents of every query that a task has seen; ties (scores alike to 9 digits) go to the smaller id."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.least = k, np.full(n_queries, -np.inf)
        self.q, self.ids, self.scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=object), np.empty(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, some: np.ndarray | None = None) -> None:
        """scores: queries x documents; some: which of them count at all."""
        rounded = np.round(scores, 9)
        if some is not None:
            rounded[~some] = -np.inf
        least = self.least
        if rounded.shape[1] > self.k:
            least = np.maximum(least, np.partition(rounded, -self.k, axis=1)[:, -self.k])
        q, d = np.nonzero((rounded >= least[:, None]) & (rounded > -np.inf))
        self.waiting.append((q, ids[d], scores[q, d]))
        self.n_waiting += len(q)
        if self.n_waiting > TILE:
            self.settle()

    def settle(self) -> None:
        q, ids, scores = (np.concatenate((a, *b)) for a, b in zip((self.q, self.ids, self.scores), zip(*self.waiting, strict=True), strict=True)) if self.waiting else (self.q, self.ids, self.scores)
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -np.round(scores, 9), q)) if len(q) else np.empty(0, dtype=np.int64)
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]
        last = place == self.k - 1
        self.least[q[last]] = np.round(scores[last], 9)
        self.waiting, self.n_waiting = [], 0


def _blocks(queries: DataFrame, key: str = "query_id") -> Iterator[DataFrame]:
    """The queries in blocks of about QUERY_BLOCK by a hash of their id."""
    n = max(1, -(-queries.select(key).distinct().count() // QUERY_BLOCK))
    for b in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == b)


def _unit_rows(vectors: list, dim: int) -> np.ndarray:
    """Unit vectors; null, zero and unequally long ones and those with NaN become zero."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = v
    n = np.linalg.norm(out, axis=1)
    good = np.isfinite(n) & (n > 0)
    return np.where(good[:, None], out, 0.0) / np.where(good, n, 1.0)[:, None]


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", id_col: str = "id", vector: str = "embedding", min_score: float | None = None) -> DataFrame:
    """query_id, id, score (cosine), rank: the k most similar corpus vectors per query.

    Null, zero, NaN and unequally long vectors score 0, as ties by id. Queries go to the
    tasks in blocks of QUERY_BLOCK, one pass over the corpus each; a task scores tiles
    of at most TILE cells and keeps k rows per query, so nothing but those is shuffled.
    An empty side gives no rows.
    """
    ids, types = corpus.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")), dict(corpus.dtypes)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    for part in _blocks(asked):
        block = part.toPandas()  # about QUERY_BLOCK rows
        if block.empty:
            continue
        dim = max((len(v) for v in block["v"] if v is not None), default=0)
        shared = corpus.sparkSession.sparkContext.broadcast((_unit_rows(block["v"].tolist(), dim), block["query_id"].to_numpy()))  # QUERY_BLOCK vectors

        def scan(batches: Iterator[pd.DataFrame], shared=shared, dim=dim) -> Iterator[pd.DataFrame]:
            q, names = shared.value
            best, step = _Best(len(q), k), max(1, TILE // len(q))
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    best.add(q @ _unit_rows(part["v"].tolist(), dim).T, part["id"].to_numpy(dtype=object))
            best.settle()
            yield pd.DataFrame({"query_id": names[best.q], "id": best.ids, "score": best.scores})

        rows = ids.mapInPandas(scan, f"query_id {dict(queries.dtypes)[query_id]}, id {types[id_col]}, score double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = ids.limit(0).mapInPandas(lambda b: iter(()), f"query_id {dict(queries.dtypes)[query_id]}, id {types[id_col]}, score double")
    out = top(found, k, ["query_id"])
    return out if min_score is None else out.where(F.col("score") >= min_score)


def bm25_index(docs: DataFrame, id_col: str = "id", text: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens id, t; terms term, df; totals n, avgdl, one row). Null texts are documents without terms. Terms are counted once per document before anything moves."""
    tokens = docs.select(F.col(id_col).alias("id"), split_tokens(F.col(text)).alias("t"))
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("avgdl"))
    terms = tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tokens, terms, totals


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 5, query_id: str = "query_id", query: str = "query_text", id_col: str = "id", text: str = "content", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, min_score: float | None = None) -> DataFrame:
    """query_id, id, score, rank. Repeated query terms count repeatedly; a negative idf becomes epsilon times the mean idf.

    Documents without any query term score 0 and fill up to k places by id, unless
    min_score leaves them out. The weighted terms of a block of QUERY_BLOCK queries go
    to every task; a task scores its documents in tiles and keeps k of them per query.
    So postings never move, and a frequent term costs its additions, not rows.
    """
    tokens, terms, totals = bm25_index(docs, id_col, text)
    idf = terms.crossJoin(totals).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # totals: one row
    mean = idf.agg((F.avg("idf") * epsilon).alias("floor"))
    named = queries.select(F.col(query_id).alias("query_id"), F.explode(split_tokens(F.col(query))).alias("term"))
    schema = f"query_id {dict(queries.dtypes)[query_id]}, id {dict(docs.dtypes)[id_col]}, score double"
    avgdl = totals.first()["avgdl"] or 1.0  # one row
    scored = None
    for part in _blocks(named):
        asked = part.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        weights = asked.join(idf, "term").crossJoin(mean).select("query_id", "term", (F.col("qf") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("w"))  # mean: one row
        block = weights.toPandas()  # the terms of about QUERY_BLOCK queries
        if block.empty:
            continue
        codes, names = pd.factorize(block["query_id"])
        by_term = {t: (codes[at], block["w"].to_numpy()[at]) for t, at in block.groupby("term").indices.items()}
        shared = docs.sparkSession.sparkContext.broadcast((by_term, np.asarray(names)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            by_term, names = shared.value
            best, step = _Best(len(names), k), max(1, TILE // len(names))
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    scores = np.zeros((len(names), len(part)))
                    hit = np.zeros(scores.shape, dtype=bool)
                    postings: dict[str, dict[int, int]] = {}
                    for d, words in enumerate(part["t"]):
                        for w in words:
                            if w in by_term:
                                held = postings.setdefault(w, {})
                                held[d] = held.get(d, 0) + 1
                    length = 1 - b + b * np.array([len(x) for x in part["t"]]) / avgdl
                    for w, held in postings.items():
                        q, weight = by_term[w]
                        d, tf = np.fromiter(held, dtype=np.int64), np.fromiter(held.values(), dtype=np.float64)
                        cells = np.ix_(q, d)
                        scores[cells] += weight[:, None] * (tf * (k1 + 1) / (tf + k1 * length[d]))
                        hit[cells] = True
                    best.add(scores, part["id"].to_numpy(dtype=object), hit)
            best.settle()
            yield pd.DataFrame({"query_id": names[best.q], "id": best.ids, "score": best.scores})

        rows = tokens.mapInPandas(scan, schema)
        scored = rows if scored is None else scored.unionByName(rows)
    if scored is None:
        scored = tokens.limit(0).mapInPandas(lambda b: iter(()), schema)
    if min_score is None:
        scored = top(scored, k, ["query_id"]).drop("rank")
        first = docs.select(F.col(id_col).alias("id")).orderBy("id").limit(2 * k)
        zero = queries.select(F.col(query_id).alias("query_id")).distinct().join(F.broadcast(first))  # 2k rows a query
        scored = scored.unionByName(zero.join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0)))
    else:
        scored = scored.where(F.col("score") >= min_score)
    return top(scored, k, ["query_id"])


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 5, constant: int = 60) -> DataFrame:
    """query_id, id, score = sum of 1 / (constant + rank) over the lists, first_list, rank. Ties go to the earlier list, then to the better place in it."""
    union = None
    for n, ranked in enumerate(lists):
        part = ranked.select("query_id", "id", "rank", F.lit(n).alias("list"))
        union = part if union is None else union.unionByName(part)
    place = F.min(F.struct("list", "rank"))
    fused = union.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"), place.alias("_place"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "_place", "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", F.col("_place.list").alias("first_list"), "rank")


def hybrid(dense: DataFrame, lexical: DataFrame, k: int = 5, threshold: float = 0.35, fallback: DataFrame | None = None, rerank: bool = True, constant: int = 60) -> DataFrame:
    """query_id, id, score, rank, method ('hybrid', 'dense' or 'fallback').

    dense and lexical are ranked lists of 2k rows a query. A query whose best dense
    score is below the threshold takes its rows from fallback, if that has any.
    """
    out = reciprocal_rank_fusion([dense, lexical], k, constant).select("query_id", "id", "score", "rank", F.lit("hybrid").alias("method")) if rerank else dense.where(F.col("rank") <= k).select("query_id", "id", "score", "rank", F.lit("dense").alias("method"))
    if fallback is None:
        return out
    sure = dense.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") >= threshold).select("query_id")
    other = fallback.where(F.col("rank") <= k).select("query_id", "id", "score", "rank", F.lit("fallback").alias("method")).join(sure, "query_id", "left_anti")
    return out.join(other.select("query_id").distinct(), "query_id", "left_anti").unionByName(other)


#: A search: (queries, number of results) to a ranked list query_id, id, score, rank.
Search = Callable[[DataFrame, int], DataFrame]


def hybrid_search(queries: DataFrame, dense: Search, lexical: Search, k: int | None = 5, threshold: float = 0.35, fallback: Search | None = None, rerank: bool = True, constant: int = 60) -> DataFrame:
    """hybrid() over searches that are plugged in; each is asked for twice as many rows as wanted. k 0 or None means the default."""
    k = default_k(k)
    return hybrid(dense(queries, 2 * k), lexical(queries, 2 * k), k, threshold, fallback(queries, k) if fallback else None, rerank, constant)


def overlap_rerank(ranked: DataFrame, query: str = "query_text", text: str = "content") -> DataFrame:
    """Orders a query's rows by the number of query tokens they hold; equal ones keep their order."""
    n = F.size(F.array_intersect(token_set(F.col(query)), token_set(F.col(text))))
    w = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), "rank")
    return ranked.withColumn("overlap", n).withColumn("rank", F.row_number().over(w))


def ends_first(ranked: DataFrame) -> DataFrame:
    """Reorders a ranked list so that the best rows stand at both ends: 1, 3, 5, ..., 6, 4, 2; adds place."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    key = F.when((F.col("rank") % 2 == 1), F.col("rank")).otherwise(2 * n + 1 - F.col("rank"))
    # two or fewer stay as they are, which the same key gives
    return ranked.withColumn("_key", key).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_key"))).drop("_key")


def context_blocks(ranked: DataFrame, header: Column, order: str = "rank", sep: str = "\n\n", text: str = "content", trimmed: bool = True) -> DataFrame:
    """query_id, context: numbered blocks of header and (trimmed) content, joined. A ranked list is short, so one row holds it."""
    body = F.coalesce(F.col(text), F.lit(""))
    block = F.struct(F.col(order).alias("o"), F.concat(header, F.lit("\n"), F.trim(body) if trimmed else body).alias("b"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), sep).alias("context"))


def reciprocal_ranks(ranked: DataFrame, expected: DataFrame, exact: bool = False, id_col: str = "id") -> DataFrame:
    """Per query of expected (query_id, expected_doc_ids): hit and rr, the reciprocal rank of the first hit; 0 without one."""
    from siltstone.functions.metrics import is_hit

    best = ranked.join(expected, "query_id").where(is_hit(F.col("expected_doc_ids"), F.col(id_col).cast("string"), exact)).groupBy("query_id").agg(F.min("rank").alias("first"))
    return expected.select("query_id").join(best, "query_id", "left").select("query_id", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def ranking_faults(ranked: DataFrame, k: int, methods: tuple[str, ...] | None = None) -> DataFrame:
    """Faults of result lists: query_id, fault ('too_many', 'duplicate_id', 'bad_score', 'not_sorted', 'bad_method'). Rows are ordered by rank."""
    w = Window.partitionBy("query_id").orderBy("rank")
    checked = ranked.withColumn("_prev", F.lag("score").over(w))
    bad = [F.when(F.col("score").isNull() | F.isnan("score"), "bad_score"), F.when(F.col("score") > F.col("_prev"), "not_sorted")]
    if methods and "method" in ranked.columns:
        bad.append(F.when(~F.coalesce(F.col("method").isin(*methods), F.lit(False)), "bad_method"))
    rows = checked.select("query_id", F.explode(F.array_compact(F.array(*bad))).alias("fault"))
    lists = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"))
    whole = lists.select("query_id", F.explode(F.array_compact(F.array(F.when(F.col("n") > max(k, 0), "too_many"), F.when(F.col("d") < F.col("n"), "duplicate_id")))).alias("fault"))
    return rows.unionByName(whole).distinct()


def lookup(rows: DataFrame, query: str, category: str = "all", limit: int = 3, title: str = "title", text: str = "content", category_col: str = "category", order: str = "id") -> DataFrame:
    """The first rows, in order, whose title or text holds the query (case apart) in the category, at most limit (1 to 10)."""
    needle = F.lit(query.strip().lower())
    hit = F.contains(F.lower(F.coalesce(title, F.lit(""))), needle) | F.contains(F.lower(F.coalesce(text, F.lit(""))), needle)
    return rows.where(hit if category == "all" else hit & (F.col(category_col) == category)).orderBy(order).limit(max(1, min(10, limit)))
