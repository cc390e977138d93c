import pytest
from pyspark.sql import functions as F

from siltstone.functions import models as U
from siltstone.functions import vectors as V
from siltstone.operators import answering as A
from siltstone.operators import chunking as C
from siltstone.operators import retrieval as R


def ranked(spark):
    rows = [("q1", "a", " first {question} ", 0.9, 1, "dense", {"source": "s", "title": "T"}), ("q1", "b", "second", 0.5, 2, "dense", {}), ("q1", "c", "third", 0.1, 3, "dense", None), ("q3", "d", None, None, 1, "reranked", {"chunk_index": "4"})]
    return spark.createDataFrame(rows, "query_id string, id string, content string, score double, rank int, method string, metadata map<string,string>")


def questions(spark):
    return spark.createDataFrame([("q1", " How? {context} "), ("q2", "Who?"), ("q3", None)], "query_id string, query_text string")


def test_answered(spark):
    out = {r["query_id"]: r for r in A.answered(questions(spark), ranked(spark), U.answerer(lambda: lambda p: p.upper()), "C:{context}|Q:{question}", 0.5).collect()}
    assert out["q1"]["prompt"] == "C:--- Document Chunk 1 [Source: s] (relevance: 0.900) ---\nfirst {question}\n\n--- Document Chunk 2 [Source: b] (relevance: 0.500) ---\nsecond|Q:How? {context}"
    assert out["q1"]["answer"] == out["q1"]["prompt"].upper() and out["q1"]["n_chunks"] == 2
    assert out["q2"]["prompt"] == f"C:{A.NOTHING}|Q:Who?" and out["q3"]["prompt"] == f"C:{A.NOTHING}|Q:"
    assert A.answered(questions(spark).limit(0), ranked(spark), U.answerer(U.mock_model)).count() == 0


def test_grounded(spark):
    def fails():
        def model(prompt):
            raise RuntimeError("no model")

        return model

    out = {r["query_id"]: r for r in A.grounded(questions(spark), ranked(spark), U.answerer(lambda: lambda p: p), "{context}#{question}").collect()}
    assert out["q2"]["answer"] == A.REFUSAL and out["q2"]["sources"] == [] and out["q2"]["retrieval_source"] == "none"
    body = out["q1"]["answer"]
    assert body.startswith("[Tài liệu 1 | Tiêu đề: T | Nguồn: s (Chunk 0)]\n first {question} \n\n---\n\n[Tài liệu 2 | Tiêu đề: Untitled") and body.index("third") < body.index("second")
    assert [x["id"] for x in out["q1"]["sources"]] == ["a", "b", "c"] and out["q1"]["retrieval_source"] == "dense"
    assert out["q3"]["retrieval_source"] == "hybrid" and "(Chunk 4)" in out["q3"]["answer"]
    broken = {r["query_id"]: r["answer"] for r in A.grounded(questions(spark), ranked(spark), U.answerer(fails)).collect()}
    assert broken["q1"] == A.FAILURE + "no model" and broken["q2"] == A.REFUSAL


def test_generation_faults(spark):
    s = "array<struct<id:string,score:double>>"
    rows = [("x", [("a", 2.0), ("b", 1.0)], "dense"), (" ", [], "none"), ("x", [("a", 1.0), ("a", 1.0)], "dense"), ("x", [("a", None)], "dense"), ("x", [("a", 1.0), ("b", 2.0)], "dense"), ("x", None, "web"), (None, None, None)]
    df = spark.createDataFrame(rows, f"a string, s {s}, r string")
    assert [r["f"] for r in df.select(A.generation_fault(F.col("a"), F.col("s"), F.col("r")).alias("f")).collect()] == [None, "no_answer", "duplicate_source", "bad_score", "not_sorted", "bad_retrieval_source", "no_answer"]


def test_confirmation(spark):
    rows = [(True, "x", "x"), (True, "x", "y"), (True, "x", ""), (True, "x", None), (False, "x", "x"), (None, "x", "x"), (True, None, None)]
    df = spark.createDataFrame(rows, "c boolean, r string, n string")
    assert [r["f"] for r in df.select(A.is_confirmed(F.col("c"), F.col("r"), F.col("n")).alias("f")).collect()] == [True, False, True, True, False, False, True]


def test_ingest_is_idempotent_and_verified(spark):
    docs = spark.createDataFrame([("a", "x" * 450, {"source": "s"}), ("b", None, None), ("c", "short", {})], "id string, content string, metadata map<string,string>")
    empty = spark.createDataFrame([], "id string, parent_doc_id string, content string, chunk_index int, metadata map<string,string>, embedding array<double>")
    once, counts = A.ingest(docs, C.fixed(F.col("_text"), 200, 0), empty, V.mock_embedding)
    twice, _ = A.ingest(docs, C.fixed(F.col("_text"), 200, 0), once, V.mock_embedding)
    assert {(r["parent_doc_id"], r["n_chunks"]) for r in counts.collect()} == {("a", 3), ("c", 1)} and once.count() == twice.count() == 4
    assert A.verify_index(once, once).first()["is_complete"]
    lost = A.verify_index(once.where("chunk_index < 2"), once).first()
    assert (lost["n_expected"], lost["n_stored"], lost["n_missing"], lost["is_complete"]) == (4, 3, 1, False)
    chunks = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, content string")
    vectors = spark.createDataFrame([("2", [1.0]), ("3", [2.0])], "id string, embedding array<double>")
    assert {(r["id"], tuple(r["embedding"] or ())) for r in A.with_vectors(chunks, vectors).collect()} == {("1", ()), ("2", (1.0,))}


def test_searches_are_plugged_in(spark):
    asked = []

    def search(name, score):
        def run(queries, k):
            asked.append((name, k))
            return queries.select("query_id", F.lit(name).alias("id"), F.lit(score).alias("score"), F.lit(1).alias("rank"))

        return run

    q = questions(spark)
    rows = R.hybrid_search(q, search("d", 0.2), search("l", 9.0), 0, 0.35, search("f", 1.0)).collect()
    assert {(r["id"], r["method"]) for r in rows} == {("f", "fallback")} and asked == [("d", 10), ("l", 10), ("f", 5)]
    rows = R.hybrid_search(q, search("d", 0.5), search("l", 9.0), 3, 0.35, search("f", 1.0)).collect()
    assert {(r["id"], r["rank"]) for r in rows} == {("d", 1), ("l", 2)}


def test_prompts_move_between_versions(spark):
    reg = spark.createDataFrame([("p", 1, "one", []), ("p", 2, "two", ["production"]), ("p", 3, "three", None), ("q", 1, "other", ["production"])], "name string, version int, template string, labels array<string>")
    served = lambda r: {(x["name"], x["version"]) for x in U.resolve_prompts(r).collect()}
    assert served(reg) == {("p", 2), ("q", 1)}
    up = U.promote(reg, "p", 3)
    assert served(up) == {("p", 3), ("q", 1)} and served(U.rollback(up, "p")) == {("p", 2), ("q", 1)} and served(U.rollback(reg, "q")) == served(reg)
    spare = {(x["name"], x["template"]) for x in U.resolve_prompts(reg, "staging", {"p": "spare"}).collect()}
    assert spare == {("p", "spare")}


def test_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 8))
    x[100:110] = x[0]  # ties go to the smaller id
    df = spark.createDataFrame([(f"d{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)] + [("null", None), ("short", [1.0]), ("nan", [float("nan")] * 8)], "id string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sims = np.round(u[:40] @ u.T, 9)
    want = {(f"d{i:03d}", f"d{j:03d}", r) for i in range(40) for r, j in enumerate(np.lexsort((np.arange(700), -sims[i]))[:6], 1)}
    import siltstone.operators.retrieval as module

    for tile, block in ((1 << 22, 20_000), (500, 7)):
        old = module.TILE, module.QUERY_BLOCK
        module.TILE, module.QUERY_BLOCK = tile, block
        try:
            got = {(r["query_id"], r["id"], r["rank"]) for r in R.dense_topk(df.where("id < 'd040'").withColumnRenamed("id", "query_id"), df, 6).collect()}
        finally:
            module.TILE, module.QUERY_BLOCK = old
        assert got == want


@pytest.mark.parametrize("value", ["x", "1.5"])
def test_settings(value):
    from siltstone import Settings

    assert Settings.read({}) == Settings() and Settings.read({"SILTSTONE_TOP_K": " 7 ", "SILTSTONE_THRESHOLD": "0.5", "SILTSTONE_RRF": ""}) == Settings(top_k=7, threshold=0.5)
    with pytest.raises(ValueError, match="SILTSTONE_TOP_K"):
        Settings.read({"SILTSTONE_TOP_K": value})
