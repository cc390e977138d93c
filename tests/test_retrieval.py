import math
from collections import Counter

from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators import retrieval as R


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, id string, score double, rank int")


def test_cosine_cases(spark):
    rows = [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 1.0], 0.0), (None, [1.0], 0.0)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>, want double").select(V.cosine(F.col("a"), F.col("b")).alias("c"), "want").collect()
    assert all(math.isclose(r["c"], r["want"], abs_tol=1e-12) for r in got)


def test_mock_embedding_is_a_unit_vector_and_repeats(spark):
    import hashlib

    s = int(hashlib.md5(b"abc").hexdigest(), 16)
    v = []
    for _ in range(64):
        s = (s * 1664525 + 1013904223) % 2**32
        v.append(s / (2**32 - 1) * 2 - 1)
    n = math.sqrt(sum(x * x for x in v))
    got = spark.createDataFrame([("abc",)], "t string").select(V.mock_embedding(F.col("t")).alias("v")).first()["v"]
    assert all(math.isclose(a, b / n, abs_tol=1e-12) for a, b in zip(got, v, strict=True))


def test_dense_ties_filters_and_bad_vectors(spark):
    corpus = spark.createDataFrame([(3, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (4, None, 3), (5, [1.0], 4)], "id int, embedding array<double>, score int")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, embedding array<double>")
    rows = R.dense_topk(queries, corpus, 4).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 3, 2, 4]
    assert R.dense_topk(queries.limit(0), corpus, 2).count() == 0
    assert R.dense_topk(queries, corpus.limit(0), 2).count() == 0
    assert R.dense_topk(queries, corpus, 4, min_score=0.5).count() == 2


def test_dense_large_batches_keep_ties(spark):
    corpus = spark.range(5000).select(F.col("id"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("embedding"))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in R.dense_topk(queries, corpus, 3).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [0, 7, 14] and [got[2, k] for k in (1, 2, 3)] == [6, 13, 20]


def test_matches(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "y", "b": "z"}), (3, None)], "id int, m map<string,string>")
    ids = lambda f: [r["id"] for r in df.where(R.matches(F.col("m"), f)).orderBy("id").collect()]
    assert ids({"a": "x"}) == [1] and ids({"b": None}) == [1, 3] and ids(None) == [1, 2, 3]


def brute_bm25(query, docs, k1=1.5, b=0.75, eps=0.25):
    toks = {i: t.lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return {i: sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query.lower().split()) for i, t in toks.items()}


def test_bm25_against_brute_force(spark):
    docs = {"a": "the cat sat on the mat", "b": "the dog", "c": "a cat and a dog and the bird", "d": "", "e": "bird bird"}
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    q = spark.createDataFrame([("q", "cat the cat bird"), ("none", "zebra")], "query_id string, query_text string")
    got = {(r["query_id"], r["id"]): (r["score"], r["rank"]) for r in R.bm25_topk(q, df, 5).collect()}
    want = brute_bm25("cat the cat bird", docs)
    assert all(math.isclose(got["q", i][0], s, abs_tol=1e-9) for i, s in want.items())
    assert [i for _, i in sorted((got["none", i][1], i) for i in docs)] == ["a", "b", "c", "d", "e"]


def test_fusion_and_fallback(spark):
    a = ranked(spark, [("q", "x", 0.9, 1), ("q", "y", 0.5, 2), ("p", "x", 0.1, 1)])
    b = ranked(spark, [("q", "y", 9.0, 1), ("q", "z", 5.0, 2), ("p", "z", 1.0, 1)])
    fused = {(r["query_id"], r["id"]): r for r in R.reciprocal_rank_fusion([a, b]).collect()}
    assert math.isclose(fused["q", "y"]["score"], 1 / 62 + 1 / 61) and fused["q", "y"]["rank"] == 1
    assert fused["p", "x"]["rank"] == 1  # the tie goes to the first list
    fall = ranked(spark, [("p", "f", 1.0, 1), ("q", "f", 1.0, 1)])
    rows = R.hybrid(a, b, 5, 0.35, fall).collect()
    assert {(r["query_id"], r["method"]) for r in rows} == {("q", "hybrid"), ("p", "fallback")}
    assert {r["method"] for r in R.hybrid(a, b, 5, 0.35, fall.limit(0)).collect()} == {"hybrid"}


def test_ends_first(spark):
    for n in range(1, 8):
        rows = R.ends_first(ranked(spark, [("q", str(i), 1.0, i) for i in range(1, n + 1)])).orderBy("place").collect()
        items = list(range(1, n + 1))
        assert [r["rank"] for r in rows] == items[::2] + items[1::2][::-1]


def test_reciprocal_ranks_prefix(spark):
    exp = spark.createDataFrame([("q", ["doc_1"]), ("p", None)], "query_id string, expected_doc_ids array<string>")
    got = ranked(spark, [("q", "a", 1.0, 1), ("q", "doc_10", 0.5, 2), ("p", "a", 1.0, 1)])
    assert {r["query_id"]: r["rr"] for r in R.reciprocal_ranks(got, exp).collect()} == {"q": 0.5, "p": 0.0}
    assert {r["query_id"]: r["rr"] for r in R.reciprocal_ranks(got, exp, exact=True).collect()}["q"] == 0.0


def test_ranking_faults(spark):
    bad = ranked(spark, [("q", "a", 0.1, 1), ("q", "a", 0.5, 2), ("r", "a", None, 1), ("s", "a", 1.0, 1)])
    assert {(r["query_id"], r["fault"]) for r in R.ranking_faults(bad, 1).collect()} == {("q", "too_many"), ("q", "duplicate_id"), ("q", "not_sorted"), ("r", "bad_score")}


def test_lookup_and_rerank(spark):
    rows = spark.createDataFrame([(2, "Cat", "x", "a"), (1, "dog", "a CAT", "b"), (3, None, None, "a")], "id int, title string, content string, category string")
    assert [r["id"] for r in R.lookup(rows, " cat ").collect()] == [1, 2] and [r["id"] for r in R.lookup(rows, "cat", "a", 99).collect()] == [2]
    lists = spark.createDataFrame([("q", "a", 1, "blue sky", "grey sea"), ("q", "b", 2, "blue sky", "sky blue"), ("q", "c", 3, "blue sky", None)], "query_id string, id string, rank int, query_text string, content string")
    assert [r["id"] for r in R.overlap_rerank(lists).orderBy("rank").collect()] == ["b", "a", "c"]


def test_context_blocks(spark):
    rows = ranked(spark, [("q", "b", 0.5, 2), ("q", "a", 0.9, 1)]).withColumn("content", F.concat(F.lit(" text "), F.col("id")))
    assert R.context_blocks(rows, F.concat(F.lit("# "), F.col("id"))).first()["context"] == "# a\ntext a\n\n# b\ntext b"
