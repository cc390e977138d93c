from collections import Counter

from pyspark.sql import functions as F

from siltstone.llm import mixing as M
from siltstone.llm import queries as Q
from siltstone.llm.tokens import token_count


def test_schedule_is_fair():
    for weights in ({"a": 5.0, "b": 3.0, "c": 1.5, "d": 0.5}, {"x": 1.0}, {"a": 1.0, "b": 1e-9}, {}):
        slots = 997
        out = M.schedule(weights, slots)
        assert len(out) == (slots if weights else 0)
        n, seen = Counter(s for s, _ in out), Counter()
        for i, (s, j) in enumerate(out, 1):
            assert j == seen[s]
            seen[s] += 1
            assert all(abs(seen[k] - n[k] * i / slots) < 1 for k in n)


def data(spark):
    rows = [(i, "big" if i < 60 else "mid" if i < 90 else "small" if i < 96 else None, 10 + i % 5) for i in range(100)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 2), ("absent", 0.1, 3), ("nulls", None, None)], "source string, target_share double, max_repeats int")
    return rows, sizes, targets


def test_supply(spark):
    rows, sizes, targets = data(spark)
    total = sum(r[2] for r in rows)
    got = {r["source"]: r for r in M.supply(sizes, targets).collect()}
    assert {s for s, r in got.items() if r["is_short"]} == {"small", "absent"}
    assert got["big"]["wanted"] == 0.4 * total and got["absent"]["capacity"] == 0


def test_mix(spark):
    _, sizes, targets = data(spark)
    out = M.mix(sizes, targets, slots=50)
    rows = out.orderBy("slot", "place").collect()
    plan = {r["source"]: r["used"] for r in M.supply(sizes, targets).collect() if r["used"] > 0}
    total, block = sum(plan.values()), sum(plan.values()) / 50
    assert max(Counter((r["doc_id"], r["source"]) for r in rows).values()) == 2
    assert all(c <= {"big": 1, "mid": 2, "small": 2}[s] for (_, s), c in Counter((r["doc_id"], r["source"]) for r in rows).items())
    done, all_done = Counter(), 0
    for slot in range(51):
        for r in (r for r in rows if r["slot"] == slot):
            done[r["source"]] += r["tokens"]
            all_done += r["tokens"]
        for s, used in plan.items():  # a block, the document that overhangs it and the overhang of the others
            assert abs(done[s] - used / total * all_done) <= 2 * block + 3 * 14
    shares = {r["source"]: r for r in M.shares(out, targets).collect()}
    assert abs(shares["big"]["tokens"] - plan["big"]) < 20 and shares["absent"]["share"] == 0.0


def test_empty(spark):
    _, sizes, targets = data(spark)
    assert M.mix(sizes.limit(0), targets).count() == 0 and M.mix(sizes, targets.limit(0)).count() == 0
    assert M.supply(sizes.limit(0), targets).where("is_short").count() == 0


def test_tokens(spark):
    rows = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "t string").select(token_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows][:3] == [2, 0, 0] and rows[3]["n"] > 1


def test_short_sources_come_from_the_schedule(spark, monkeypatch):
    _, sizes, targets = data(spark)
    planned, plan = [], M.schedule
    monkeypatch.setattr(M, "schedule", lambda weights, slots: planned.append(set(weights)) or plan(weights, slots))
    monkeypatch.setattr(Q, "_sizes", lambda spark, d: sizes)
    monkeypatch.setattr(Q, "table", lambda spark, d, name: targets)
    assert {r["source"] for r in Q.p7_found(spark, "").collect()} == {"small", "absent"} and planned == [{"big", "mid", "small"}]
    got = {r["source"]: r for r in M.short(sizes, targets, 50).collect()}
    assert got["small"]["given"] == 2 * 70 and got["small"]["blocks"] > 1 and got["absent"]["blocks"] == 0
    assert M.short(sizes.limit(0), targets).count() == 0 and M.short(sizes, targets.limit(0)).count() == 0


def test_blocks_of_a_given_size(spark):
    _, sizes, targets = data(spark)
    out = M.mix(sizes, targets, slots=20, block_tokens=12.0)
    rows = out.orderBy("slot", "place").collect()
    plan = {r["source"]: r["used"] for r in M.supply(sizes, targets).collect() if r["used"] > 0}
    total = sum(plan.values())
    assert max(r["slot"] for r in rows) >= total / 12 * 0.8 and len(rows) == M.mix(sizes, targets, slots=20).count()
    done = Counter()
    for n, r in enumerate(rows):
        done[r["source"]] += r["tokens"]
        if n + 1 == len(rows) or rows[n + 1]["slot"] != r["slot"]:
            so_far = sum(done.values())
            assert all(abs(done[s] - used / total * so_far) <= 2 * 12 + 4 * 14 for s, used in plan.items())


def test_every_source_gets_a_block():
    assert {s for s, _ in M.schedule({"a": 1.0, "b": 1e-9, "c": 1e-9}, 50)} == {"a", "b", "c"}
