import datetime as dt
import random

from siltstone.operators.orphans import BUCKET, key_runs, orphan_counts, orphan_references

T = dt.datetime(2024, 5, 1)
REFS = "src_table string, record_id string, ref_id string, at timestamp, reason string"
PARENTS = "id string, created_at double, deleted_at double, key string"


def run(spark, refs, parents):
    r = spark.createDataFrame([(*x, "clash") for x in refs], REFS)
    p = spark.createDataFrame([(*x, "clash") for x in parents], PARENTS)
    return {(x["record_id"], x["ref_id"], x["reason"], x["ref_month"]) for x in orphan_references(r, p).collect()}


def test_reasons(spark):
    early, late = T.timestamp() - 100, T.timestamp() + 100
    parents = [(" Doc-1 ", early, None), ("doc-2", early, 5.0), ("doc-3", late * 1000, None), ("doc-4", None, None), ("doc-5", early, 5.0), ("doc-5", early + 1, None), ("doc-07", early, None), (None, early, None)]
    refs = [("c", str(i), x, T) for i, x in enumerate(["doc-1", "DOC-2", "doc-3", "doc-4", "doc-5", "doc-7", "doc-07", None, " ", "doc-6", "uuid-a"])]
    assert run(spark, refs, parents) == {("1", "doc-2", "deleted", "2024-05"), ("2", "doc-3", "late", "2024-05"), ("5", "doc-7", "missing", "2024-05"), ("9", "doc-6", "missing", "2024-05"), ("10", "uuid-a", "missing", "2024-05")}


def test_nulls_and_empty_tables(spark):
    assert run(spark, [], [("a", 1.0, None)]) == set()
    assert run(spark, [("c", "1", "a", None)], []) == {("1", "a", "missing", None)}
    assert run(spark, [("c", "1", "a", None)], [("a", 1e10, None)]) == set()
    assert run(spark, [("c", "1", "a", T), ("c", "1", "a", T)], []) == {("1", "a", "missing", "2024-05")}


def test_against_sets_with_a_hot_key(spark):
    rng = random.Random(3)
    have = {f"doc-{n}" for n in rng.sample(range(BUCKET - 50, BUCKET + 50), 60)} | {"x9", "y"}
    refs = [("c", str(i), f"doc-{rng.randrange(BUCKET - 60, BUCKET + 60)}", T) for i in range(300)] + [("c", f"h{i}", "doc-hot", T) for i in range(300)]
    got = run(spark, refs, [(k, 1.0, None) for k in have])
    assert {(r, k) for r, k, _, _ in got} == {(r, k) for _, r, k, _ in refs if k not in have}


def test_runs_and_counts(spark):
    keys = spark.createDataFrame([(f"a{n}",) for n in (1, 2, 3, 5, 9)] + [("b",), (None,)], "k string")
    assert {(r["_prefix"], r["run_start"], r["run_end"]) for r in key_runs(keys, "k").collect()} == {("a#1", 1, 3), ("a#1", 5, 5), ("a#1", 9, 9), ("b#0", 0, 0)}
    o = orphan_references(spark.createDataFrame([("c", str(i), "z", T, "") for i in range(3)], REFS), spark.createDataFrame([], PARENTS))
    assert [tuple(r) for r in orphan_counts(o).collect()] == [("c", "2024-05", "missing", 3, 1)]
