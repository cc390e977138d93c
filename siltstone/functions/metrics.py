"""Evaluation measures over token arrays. Empty denominators give the stated value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def covered(part: Column, by: Column, if_empty: float = 1.0) -> Column:
    """Share of the distinct tokens of part that by holds."""
    n = F.size(part)
    return F.when(n > 0, F.size(F.array_intersect(part, by)) / F.when(n > 0, n)).otherwise(F.lit(if_empty))


def context_precision(expected: Column, contexts: Column, least: float = 0.1) -> Column:
    """Average precision of ranked contexts (an array of token arrays): a context is relevant if it covers at least ``least`` of expected.

    1 if expected is empty; 0 without contexts or relevant ones.
    """
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))

    def step(acc: Column, c: Column) -> Column:
        k, relevant = acc["k"] + 1, covered(expected, c) >= least
        hits = acc["hits"] + relevant.cast("int")
        return F.struct(k.alias("k"), hits.alias("hits"), (acc["total"] + F.when(relevant, hits / k).otherwise(0.0)).alias("total"))

    end = F.aggregate(F.coalesce(contexts, F.array().cast("array<array<string>>")), start, step)
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.when(end["hits"] > 0, end["total"] / F.when(end["hits"] > 0, end["hits"])).otherwise(F.lit(0.0)))


def token_f1(predicted: Column, truth: Column) -> Column:
    """Overlap of the token sets over the token counts (repeated tokens lower it); 1 if both are empty, 0 if one is."""
    p, t, common = F.size(predicted), F.size(truth), F.size(F.array_intersect(predicted, truth))
    return F.when((p == 0) & (t == 0), F.lit(1.0)).when((p == 0) | (t == 0) | (common == 0), F.lit(0.0)).otherwise(2.0 * common / (p + t))


def multiset_f1(predicted: Column, truth: Column) -> Column:
    """The usual token F1, in which a repeated token counts as often as both have it."""
    common = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(predicted, lambda x: x == w)), F.size(F.filter(truth, lambda x: x == w))))
    p, t = F.size(predicted), F.size(truth)
    return F.when((p == 0) & (t == 0), F.lit(1.0)).when((p == 0) | (t == 0), F.lit(0.0)).otherwise(2.0 * common / F.when(p + t > 0, p + t))


def heuristic_score(f1: Column) -> Column:
    """From 1 to 5 by F1."""
    return 1.0 + F.least(F.lit(4.0), 4.0 * f1)


def scaled(value: Column, low: float, high: float) -> Column:
    """Clamped to 0..1; a missing value counts as the middle."""
    v = F.coalesce(value.cast("double"), F.lit((low + high) / 2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


def failure_type(faithfulness: Column, relevance: Column, completeness: Column, error: Column, pass_mark: float = 0.5, low: float = 0.3) -> Column:
    """Null if all three reach pass_mark; else the first of error, hallucination, irrelevant, incomplete, off_topic that holds."""
    passed = (faithfulness >= pass_mark) & (relevance >= pass_mark) & (completeness >= pass_mark)
    return (
        F.when(error.isNotNull(), "error")
        .when(passed, F.lit(None).cast("string"))
        .when(faithfulness < low, "hallucination")
        .when(relevance < low, "irrelevant")
        .when(completeness < low, "incomplete")
        .otherwise("off_topic")
    )


def root_cause(faithfulness: Column, relevance: Column, completeness: Column, context_recall: Column, context_precision_: Column, error: Column) -> Column:
    """'error', 'recall', 'ranking', 'compound' (two lowest alike), else the lowest of the three."""
    lowest = F.least(faithfulness, relevance, completeness)
    ties = sum(((F.abs(x - lowest) < 1e-4).cast("int") for x in (relevance, completeness)), (F.abs(faithfulness - lowest) < 1e-4).cast("int"))
    return (
        F.when(error.isNotNull(), "error")
        .when(context_recall < 0.3, "recall")
        .when(context_precision_ < 0.2, "ranking")
        .when(ties > 1, "compound")
        .when(F.abs(faithfulness - lowest) < 1e-4, "groundedness")
        .when(F.abs(relevance - lowest) < 1e-4, "relevance")
        .otherwise("completeness")
    )


def is_hit(expected: Column, found: Column, exact: bool = False) -> Column:
    """Whether an id equals, or begins with, one of the expected ids."""
    return F.coalesce(F.exists(expected, lambda e: (found == e) if exact else found.startswith(e)), F.lit(False))
