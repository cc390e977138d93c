import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import models as MO
from siltstone.sources import files, logs, store
from siltstone.sources import files as FS
from siltstone.sources import store as ST
from siltstone.streaming import operators as S


def test_scan_documents(spark, tmp_path):
    d = tmp_path / "policies"
    d.mkdir()
    (d / "my_first-doc.md").write_text("# A  \n\n\n\nb", encoding="utf-8")
    (d / "x.json").write_text(json.dumps({"content_markdown": "", "content": "body", "doc_type": "note"}))
    (d / "y.json").write_text(json.dumps({"other": 1}))
    (d / "page.html").write_text("<p>x</p>")
    (d / ".hidden.md").write_text("no")
    (d / "blank.txt").write_text(" \n ")
    (d / "skip.csv").write_text("no")
    rows = {r["id"]: r for r in files.scan_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"my_first-doc", "x", "y", "page"}
    assert rows["my_first-doc"]["content"] == "# A\n\nb" and rows["my_first-doc"]["metadata"] == {"source": "my_first-doc.md", "title": "My First Doc", "doc_type": "policies"}
    assert rows["x"]["content"] == "body" and rows["x"]["metadata"]["doc_type"] == "note" and json.loads(rows["y"]["content"]) == {"other": 1}


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01T00", "event": "a", "error_type": null, "latency_ms": 5}\n\nnot json\n{"event": "b"}\n[1]\n')
    rows = {r["event"]: r for r in logs.load_logs(spark, str(tmp_path / "log.jsonl")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["has_error_type"] and not rows["b"]["has_error_type"] and rows["a"]["latency_ms"] == 5.0
    assert [r["event"] for r in logs.load_logs(spark, str(tmp_path / "log.jsonl"), start="2024").collect()] == ["a"]


def test_store(spark):
    chunks = spark.createDataFrame([("a_0", "a", "text", {"k": "v"}, None), ("b_0", "b", " ", {}, None), ("c_0", None, "t", {"doc_id": "z"}, [1.0])], "id string, parent_doc_id string, content string, metadata map<string,string>, embedding array<double>")
    rows = {r["id"]: r for r in store.records(chunks).collect()}
    assert set(rows) == {"a_0", "c_0"} and rows["a_0"]["metadata"] == {"k": "v", "doc_id": "a"} and len(rows["a_0"]["embedding"]) == 64 and rows["c_0"]["embedding"] == [1.0]
    s = store.records(chunks)
    change = s.where("id = 'a_0'").withColumn("content", F.lit("new"))
    once = store.upsert(s, change)
    assert sorted((r["id"], r["content"]) for r in store.upsert(once, change).collect()) == [("a_0", "new"), ("c_0", "t")]
    assert store.delete_document(s, "a").count() == 1 and store.delete_document(s, "z").count() == 1 and store.delete_document(s, "none").count() == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, t string")
    files.write_report(df, str(tmp_path / "r"))
    files.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4
    assert files.markdown_table(df.orderBy("id")).split("\n")[2] == "| 1 | a\\|b |"
    assert files.snapshot(df, str(tmp_path / "snap")).count() == 2


def test_models(spark):
    df = spark.createDataFrame([("ok",), ("bad",)], "p string")

    def load():
        def model(p):
            if p == "bad":
                raise ValueError("no")
            return p.upper()

        return model

    assert [(r["x"]["answer"], r["x"]["error"]) for r in df.select(MO.answerer(load)(F.col("p")).alias("x")).collect()] == [("OK", None), (None, "no")]
    s = spark.createDataFrame([('x {"a": 5, "b": "?"} y',), ("none",)], "r string").select(MO.judge_scores(F.col("r"), ["a", "b"]).alias("s")).collect()
    assert [tuple(r["s"]) for r in s] == [(1.0, 0.5), (0.5, 0.5)]
    reg = spark.createDataFrame([("n", 1, "old", ["production"]), ("n", 2, "new", ["staging"])], "name string, version int, template string, labels array<string>")
    assert MO.resolve_prompts(reg).first()["template"] == "old"


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", t(0), True), ("a", t(0), True), ("b", t(1), False), ("c", t(30), False), ("d", t(59), False)]
    spark.createDataFrame(rows, "id string, ts timestamp, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name, mode="append"):
        got = []
        S.run_available(make(spark.readStream.schema("id string, ts timestamp, bad boolean").parquet(str(tmp_path / "in"))), lambda df, n: got.extend(df.collect()), str(tmp_path / name), mode).awaitTermination()
        return got

    assert sorted(r["id"] for r in run(lambda s: S.without_replays(s, "id", "ts"), "dedup")) == ["a", "b", "c", "d"]
    rates = {r["window_start"].minute: (r["n"], r["n_bad"]) for r in run(lambda s: S.windowed_rates(s, "ts", F.col("bad")), "rates", "complete")}
    assert rates[0] == (2, 2) and rates[1] == (1, 0)
    assert run(lambda s: S.block_alerts(s, F.col("bad"), ["id"], 0.4, 2), "block", "update")[0]["id"] in "abcd"
    both = run(lambda s: S.paired(s.where("id = 'a'").select("id", "ts"), s.select("id", "ts", "bad"), "id", "ts"), "pairs")
    assert any(r["started_at"] is not None for r in both)


def test_held_alerts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(minutes=m), b) for m, b in ((0, True), (1, True), (2, True), (3, True), (4, False), (5, True), (7, True), (8, True), (9, None))] + [("b", base, True), (None, base, True)]
    spark.createDataFrame(rows, "s string, at timestamp, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = S.held_alerts(spark.readStream.schema("s string, at timestamp, bad boolean").parquet(str(tmp_path / "in")), "s", "at", "bad", 60, 180)
    S.run_available(stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert [(r["series"], r["run_start"].minute, r["fired_at"].minute) for r in got] == [("a", 0, 2)]


def test_corpus_by_manifest(spark, tmp_path):
    import json

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "c.bin").write_text("no")
    found = FS.load_corpus(spark, str(tmp_path))
    assert {(r["path"], r["text"]) for r in found.collect()} == {("a/x.md", "one"), ("b.txt", "two")}
    (tmp_path / "manifest.json").write_text(json.dumps({"documents": [{"path": "a/./x.md"}, "c.bin"]}))
    assert {(r["path"], r["text"], r["fault"]) for r in FS.load_corpus(spark, str(tmp_path)).collect()} == {("a/./x.md", "one", None), ("c.bin", "no", None)}
    (tmp_path / "manifest.json").write_text(json.dumps({"documents": ["../b.txt", "a/../../b.txt", "/etc/x", "gone.md", "a/../b.txt"]}))
    faults = {r["path"]: r["fault"] for r in FS.load_corpus(spark, str(tmp_path), strict=False).collect()}
    assert faults["../b.txt"] == faults["a/../../b.txt"] == faults["/etc/x"] == "escapes" and faults["gone.md"] == "missing"
    with pytest.raises(ValueError, match="escapes"):
        FS.load_corpus(spark, str(tmp_path))
    digests = {r["name"]: r["digest"] for r in FS.file_manifest(spark, str(tmp_path), ["b.txt", "none"]).collect()}
    assert digests["none"] == "missing" and len(digests["b.txt"]) == 12


def test_snapshots_are_written_once(spark, tmp_path):
    calls = []
    fetch = lambda: calls.append(1) or spark.range(3)
    path = str(tmp_path / "raw")
    assert FS.fetched(spark, path, fetch).count() == FS.fetched(spark, path, fetch).count() == 3 and len(calls) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        FS.snapshot(spark.range(1), path)


def test_reports(spark):
    from siltstone.operators import quality as Q

    df = spark.createDataFrame([(1, "x|y"), (1, None)], "id int, t string")
    gate = FS.gate_markdown(Q.quality_gate(df, Q.GateRules(1, 5, ("t",), ("id",))))
    assert gate.count("❌ Fail") == 2 and gate.count("✅ Pass") == 1
    fresh = Q.freshness(spark.createDataFrame([(None,)], "ts timestamp"), "ts", F.lit("2024-01-01"))
    assert "N/A" in FS.freshness_markdown(fresh) and "100.00%" in FS.freshness_markdown(fresh)
    assert "❌ Fail" in FS.evaluation_markdown(spark.createDataFrame([(0.5, None)], "a double, b double"), {"a": 0.4, "b": 0.1})
    assert "x\\|y" in FS.markdown_table(df) and FS.markdown_table(df, 1).endswith("more than 1 rows")


def test_upsert_takes_the_newest_change(spark):
    store = spark.createDataFrame([("a", "old", 0), ("b", "kept", 0)], "id string, content string, version int")
    changes = spark.createDataFrame([("a", "new", 2), ("a", "newer", 3), ("a", "older", 1), ("c", "x", 1), ("c", "y", 1)], "id string, content string, version int")
    for part in (1, 5):
        got = {(r["id"], r["content"]) for r in ST.upsert(store, changes.repartition(part), version="version").collect()}
        assert got == {("a", "newer"), ("b", "kept"), ("c", "y")}
    assert ST.append(store, changes.where("id = 'a'")).count() == 5 and ST.size(store).first()["n_ids"] == 2
