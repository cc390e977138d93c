
from pyspark.sql import functions as F

from siltstone.operators import chaos as X
from siltstone.operators import quality as Q


def test_gate(spark):
    df = spark.createDataFrame([(1, "abc", 1.0), (1, None, float("nan")), (None, "x", 2.0)], "id int, t string, v double")
    rules = Q.GateRules(1, 2, ("t", "v", "gone"), ("id", "gone"), {"t": 2, "gone": 1}, {"positive": "v > 0"})
    got = {(r["rule"], r["column_name"]): (r["passed"], r["observed"]) for r in Q.quality_gate(df, rules).collect()}
    assert got == {("row_count", None): (False, 3), ("not_null", "t"): (False, 1), ("not_null", "v"): (False, 1), ("not_null", "gone"): (False, 3), ("unique", "id"): (False, 1), ("min_length", "t"): (False, 2), ("custom:positive", None): (True, 0)}
    v = Q.verdict(Q.quality_gate(df, rules)).first()
    assert (v["passed"], v["has_warnings"], v["n_rules"], v["n_failed"]) == (False, True, 7, 6)
    assert not Q.verdict(Q.quality_gate(df.limit(0), rules)).first()["passed"]


def test_freshness(spark):
    ref = F.lit("2024-01-11 00:00:00")
    df = spark.createDataFrame([("2024-01-10",), ("2023-01-01",), ("bad",), (None,)], "ts string")
    r = Q.freshness(df, "ts", ref, 180, 0.25).first()
    assert (r["n"], r["n_valid"], r["n_stale"], r["stale_ratio"], r["is_fresh"], r["min_age_days"]) == (4, 2, 1, 0.25, True, 1.0)
    r = Q.freshness(df.where("ts = 'bad'"), "ts", ref).first()
    assert (r["n_stale"], r["is_fresh"]) == (1, False)
    assert Q.freshness(df.limit(0), "ts", ref).first()["is_fresh"] is False


def test_document_faults(spark):
    df = spark.createDataFrame([("1", "x", {"source": "s", "title": "t"}, 0), ("2", " ", {}, 0), ("3", "x", {"source": "s"}, 0), ("4", "x", {"source": "s", "title": "t"}, -1)], "id string, content string, metadata map<string,string>, i int")
    assert {(r["id"], r["fault"]) for r in Q.document_faults(df, index="i").collect()} == {("2", "no_content"), ("3", "no_title"), ("4", "bad_index")}


def test_chaos_and_repair(spark):
    df = spark.range(100).select(F.col("id"), F.lit("text").alias("t"), F.expr("timestampadd(DAY, id, timestamp'2024-01-01')").alias("ts"))
    assert X.blank_text(df, "t", "id").where("t = ''").count() == 15
    assert X.add_noise(df, "t", "id").where("t <> 'text'").count() == 15
    assert X.duplicate_rows(df, "id").count() == 115
    assert X.backdate(df, "ts", "id").where("ts < '2024-01-01'").count() == 25
    kept = X.drop_latest(df, "ts", "id")
    assert kept.count() == 80 and kept.agg(F.max("id")).first()[0] == 79
    assert X.drop_latest(df.limit(4), "ts", "id").count() == 4
    assert X.blank_text(df.limit(0), "t", "id").count() == 0
    # the same rows whatever the partitioning
    a = {r["id"] for r in X.blank_text(df.repartition(7), "t", "id").where("t = ''").collect()}
    assert a == {r["id"] for r in X.blank_text(df, "t", "id").where("t = ''").collect()}


def test_latest_versions_and_quarantine(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", None, "x"), (None, 1, "y")], "k string, v int, t string")
    for _ in range(2):
        assert {(r["k"], r["t"]) for r in X.latest_versions(rows, "k", "v").collect()} == {("a", "new"), ("b", "x")}
        rows = X.latest_versions(rows, "k", "v").unionByName(rows)
    good, bad = X.quarantine(rows, F.col("v") > 0)
    assert good.count() + bad.count() == rows.count() and bad.where("v is null").count() == bad.count()


def test_states(spark):
    s = lambda n: spark.createDataFrame([(n, 1)], "a int, b int")
    r = {x["metric"]: x for x in X.compare_states({"clean": s(10), "broken": s(4), "fixed": s(9)}, ["a", "b"]).collect()}
    assert r["a"]["delta_total"] == -1 and r["a"]["delta_repaired"] == 5
