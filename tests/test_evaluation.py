import math

from pyspark.sql import functions as F

from siltstone.functions import metrics as M
from siltstone.operators import evaluation as E
from siltstone.operators import toolcalls as TC


def arrays(spark, *cols):
    return spark.createDataFrame([cols], ", ".join(f"c{i} array<string>" for i in range(len(cols))))


def test_token_f1(spark):
    def f(p, t, g=M.token_f1):
        return arrays(spark, p, t).select(g(F.col("c0"), F.col("c1")).alias("x")).first()["x"]

    assert f([], []) == 1.0 and f(["a"], []) == 0.0 and f(["a"], ["b"]) == 0.0
    assert math.isclose(f(["a", "a", "b"], ["a", "c"]), 2 * 1 / 5)
    assert math.isclose(f(["a", "a"], ["a", "a"], M.multiset_f1), 1.0)


def test_context_precision(spark):
    df = spark.createDataFrame([(["x", "y"], [["x"], ["q"], ["y"]]), ([], [["x"]]), (["x"], [])], "e array<string>, c array<array<string>>")
    got = [r["p"] for r in df.select(M.context_precision(F.col("e"), F.col("c")).alias("p")).collect()]
    assert math.isclose(got[0], (1 + 2 / 3) / 2) and got[1:] == [1.0, 0.0]


def test_samples(spark):
    rows = [("what colour sky", "sky blue", "sky blue colour", ["blue sky"], None), ("q", "e", "", None, None), ("q", "e", "a", None, "boom"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "question string, expected_answer string, actual_answer string, ctx array<string>, err string")
    a, b, c, d = E.evaluate_samples(df, contexts="ctx", error="err").collect()
    assert math.isclose(a["faithfulness"], 2 / 3) and a["passed"] and a["context_recall"] == 1.0
    assert b["failure_type"] in ("irrelevant", "incomplete") and c["failure_type"] == "error" and c["overall"] == 0.0
    assert d["passed"] and d["context_recall"] is None


def test_summary_gate_regression(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", False, 0.0), ("b", True, None)], "k string, passed boolean, faithfulness double")
    s = {r["k"]: r for r in E.summarize(rows, ["k"]).collect()}
    assert s[None]["n"] == 3 and s[None]["pass_rate"] == 0.667 and s["b"]["avg_faithfulness"] is None
    whole = E.summarize(rows)
    assert [r["metric"] for r in E.gate(whole, {"pass_rate": 0.8, "avg_faithfulness": 0.5}).collect()] == ["pass_rate"]
    base = spark.createDataFrame([(0.9,)], "pass_rate double")
    r = E.regressions(whole, base, ["pass_rate"]).first()
    assert r["delta"] == -0.233 and r["is_regression"]
    assert E.summarize(rows.limit(0)).first()["n"] == 0


def test_golden_faults(spark):
    pairs = spark.createDataFrame(
        [("1", "A  b?", "x", [("d1", "snip"), ("d9", "q")]), ("2", "a B?", " ", [("d1", "absent")]), ("2", "c", "y", []), (None, None, "z", None)],
        "id string, question string, expected_answer string, ctx array<struct<source_doc:string,text:string>>",
    )
    corpus = spark.createDataFrame([("d1", "a snip b")], "doc_id string, text string")
    got = {(r["id"], r["fault"]) for r in E.golden_faults(pairs, corpus, contexts="ctx").collect()}
    assert got == {("1", "unknown_source"), ("2", "no_answer"), ("2", "duplicate_question"), ("2", "duplicate_id"), ("2", "no_contexts"), ("2", "not_in_source"), (None, "no_id"), (None, "no_question"), (None, "no_contexts")}


def test_biases_and_ab(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 3 else 0.2, "w " * (9 if i < 3 else 1)) for i in range(6)], "seq int, score double, a string")
    r = E.judge_biases(rows, answer="a").first()
    assert r["is_positional"] and r["is_verbose"] and not r["is_lenient"]
    ab = spark.createDataFrame([("x", 0.4, 1.0), ("y", 0.9, 0.5)], "v string, m double, n double")
    d = E.ab_delta(ab, "v", ("x", "y"), ["m", "n"]).first()
    assert math.isclose(d["delta_m"], 0.5) and d["delta_n"] == -0.5
    assert math.isclose(E.ab_delta(ab, "v", ("x", "y"), ["m"]).first()["delta_m"], 0.5)


def test_hits_and_numbers(spark):
    df = spark.createDataFrame([(["a", None], [None, "b"]), (["a"], ["a", None]), (None, ["a"])], "r array<string>, t array<string>")
    assert [r["h"] for r in df.select(E.hit_rate(F.col("r"), F.col("t")).alias("h")).collect()] == [0, 1, 0]
    failed = spark.createDataFrame([(2, False), (1, False), (3, True)], "id int, passed boolean")
    assert [(r["id"], r["failure_id"]) for r in E.numbered_failures(failed, "id").orderBy("id").collect()] == [(1, "F001"), (2, "F002")]


def test_every_kind_of_tool_failure():
    call = lambda name, **args: {"name": name, "args": args}
    want = [call("a", x=1), call("b", y=["p", "q"])]
    kinds = {
        None: [call("b", y=["q", "p", "r"]), call("a", x=1)],
        "wrong_argument_values": [call("a", x=2), call("b", y=["p", "q"])],
        "wrong_tool_or_count": [call("a", x=1), call("b", y=["p", "q"]), call("a", x=1)],
    }
    for kind, got in kinds.items():
        g = TC.grade_case(want, got, False)
        assert g["mismatch"] == kind and g["passed"] == (kind is None)
    missing = TC.grade_case(want, want[:1], False)
    assert (missing["routing_correct"], missing["args_correct"], missing["n_missing"], missing["n_extra"]) == (False, False, 1, 0)
    assert TC.grade_case(want, want, True)["mismatch"] == "unexpected_tool_call" and TC.grade_case([], [], True)["passed"]
    # the call that meets all arguments is taken, not the first of its name
    assert TC.grade_case([call("a", x=1), call("a", x=2)], [call("a", x=2), call("a", x=1)], False)["passed"]


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = {r["k"]: r["n"] for r in E.numbered(rows, "k", ranges=9).collect()}
    assert got == {k: k + 1 for k in range(1000)}
    assert E.numbered(rows.limit(0), "k").count() == 0


def test_halves_are_counted_not_measured(spark):
    rows = [(k if k < 10 else 1000 + k, 1.0 if k < 10 else 0.0) for k in range(20)]  # a gap in the places
    out = E.judge_biases(spark.createDataFrame(rows, "seq long, score double")).first()
    assert out["is_positional"] and out["half_gap"] == 1.0


def test_exact_quantiles_against_numpy(spark):
    import numpy as np

    from siltstone.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(2)
    values = {"a": rng.lognormal(3, 2, 20000), "b": np.repeat([1.0, 5.0, 5.0, 9.0], 2500), "c": np.array([4.0]), None: rng.normal(size=37)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("d", float("nan"))], "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert {k[0] for k in got} == {"a", "b", "c", None}
    for (g, q), v in got.items():
        assert abs(v - np.quantile(values[g], q)) < 1e-9
    assert exact_quantiles(df.limit(0), [], "v", (0.5,)).count() == 0
