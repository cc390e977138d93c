"""Grading of tool calls against what was expected.

Calls are JSON: an array of {"name", "args"}. Which actual call answers which
expected one depends on those taken before, so one Arrow batch function grades a
case; suites are plain aggregations.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("passed", "routing_correct", "args_correct", "n_extra", "n_missing", "mismatch")
GRADE = "struct<passed boolean, routing_correct boolean, args_correct boolean, n_extra int, n_missing int, mismatch string>"


def normal(value):
    """Values as they compare: texts without blanks around and in lower case, lists without order, objects by key."""
    if isinstance(value, str):
        return value.strip().lower()
    if isinstance(value, list):
        return sorted((normal(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    if isinstance(value, dict):
        return {k: normal(value[k]) for k in sorted(value)}
    return value


def matched_arguments(expected: dict, actual: dict) -> int:
    """How many expected arguments are met; of two lists the expected one may be a part."""

    def meets(want, got) -> bool:
        want, got = normal(want), normal(got)
        return all(w in got for w in want) if isinstance(want, list) and isinstance(got, list) else want == got

    return sum(meets(v, actual.get(k)) for k, v in expected.items())


def answers(expected: list, actual: list) -> list[int | None]:
    """For each expected call in turn the number of the actual call that answers it: of the calls of its name not yet taken the first that meets all arguments, else the one that meets most, of equal ones the first."""
    by_name: dict[str, list[int]] = {}
    for i, call in enumerate(actual):
        by_name.setdefault(call.get("name"), []).append(i)
    out = []
    for want in expected:
        open_ = by_name.get(want.get("name"), [])
        met = [matched_arguments(want.get("args") or {}, actual[i].get("args") or {}) for i in open_]
        out.append(open_.pop(met.index(max(met))) if open_ else None)
    return out


def grade_case(expected: list, actual: list, no_tool: bool) -> dict:
    """Routing is right if every expected call has an answer and no call is left over; arguments are right if every expected call has an answer that meets them all.

    mismatch: 'unexpected_tool_call' (none was wanted), else 'wrong_tool_or_count', else 'wrong_argument_values'.
    """
    taken = answers([] if no_tool else expected, actual)
    n_missing = sum(i is None for i in taken)
    n_extra = len(actual) - (len(taken) - n_missing)
    met = all(i is not None and matched_arguments(w.get("args") or {}, actual[i].get("args") or {}) == len(w.get("args") or {}) for w, i in zip(expected, taken, strict=True)) if not no_tool else not n_extra
    routed = not (n_missing or n_extra)
    mismatch = None if routed and met else "unexpected_tool_call" if no_tool else "wrong_argument_values" if routed else "wrong_tool_or_count"
    return {"passed": routed and met, "routing_correct": routed, "args_correct": met, "n_extra": n_extra, "n_missing": n_missing, "mismatch": mismatch}


def graded(expected: Column, actual: Column, no_tool: Column) -> Column:
    """struct(passed, routing_correct, args_correct, n_extra, n_missing, mismatch); null, unreadable and non-list JSON counts as no calls."""

    def read(t) -> list:
        try:
            v = json.loads(t) if t else []
        except ValueError:
            v = []
        return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []

    @F.pandas_udf(GRADE)
    def apply(want: pd.Series, got: pd.Series, none: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([grade_case(read(w), read(g), bool(n)) for w, g, n in zip(want, got, none, strict=True)], columns=list(FIELDS)).astype({"n_extra": "int32", "n_missing": "int32"})

    return apply(expected, actual, F.coalesce(no_tool, F.lit(False)))


def suite(cases: DataFrame, grade: str = "grade", by: list[str] | None = None) -> DataFrame:
    """n, n_passed, pass_rate, routing_accuracy, args_accuracy, extra_calls_rate (every routing failure, missing calls included) and unsolicited_rate (cases with calls that answer nothing)."""
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    g = F.col(grade)
    return (cases.groupBy(*by) if by else cases.groupBy()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(g["passed"]).alias("n_passed"), share(g["passed"]).alias("pass_rate"), share(g["routing_correct"]).alias("routing_accuracy"), share(g["args_correct"]).alias("args_accuracy"),
        share(~g["routing_correct"]).alias("extra_calls_rate"), share(g["n_extra"] > 0).alias("unsolicited_rate"),
    )


def failure_types(cases: DataFrame, grade: str = "grade", kind: Column | None = None) -> DataFrame:
    """Failed cases per kind (the case's own failure type if given, else the mismatch found): failure_type, n."""
    rows = cases.where(~F.col(grade)["passed"])
    return rows.groupBy(F.coalesce(kind if kind is not None else F.col(grade)["mismatch"], F.lit("unknown")).alias("failure_type")).agg(F.count(F.lit(1)).alias("n"))
