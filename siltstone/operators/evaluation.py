"""Evaluation of answers and retrieval: per-row measures, summaries, gates, regressions, golden-set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import metrics as M
from siltstone.functions.text import is_blank, plain_tokens, question_key, split_tokens, strip, token_set
from siltstone.operators.quantiles import exact_quantiles
from siltstone.session import drawn

#: Tasks that the rows of one repeated question are spread over.
SALTS = 16


def evaluate_samples(samples: DataFrame, question: str = "question", expected: str = "expected_answer", answer: str = "actual_answer", contexts: str | None = None, error: str | None = None) -> DataFrame:
    """Adds faithfulness (to the contexts, else to the expected answer), relevance, completeness, context_recall, context_precision, overall, passed, failure_type.

    Null texts have no tokens. Rows with an error score 0 throughout. The context
    measures are null without contexts.
    """
    a, q, e = token_set(F.col(answer)), token_set(F.col(question)), token_set(F.col(expected))
    err = F.col(error) if error else F.lit(None).cast("string")
    chunks = F.transform(F.coalesce(F.col(contexts), F.array().cast("array<string>")), lambda c: token_set(c)) if contexts else F.array().cast("array<array<string>>")
    some = F.size(chunks) > 0
    ground = F.when(some, F.array_distinct(F.flatten(chunks))).otherwise(e)
    zero = lambda c: F.when(err.isNotNull(), F.lit(0.0)).otherwise(c)
    out = samples.withColumns({
        "faithfulness": zero(M.covered(a, ground)),
        "relevance": zero(M.covered(q, a)),
        "completeness": zero(M.covered(e, a)),
        "context_recall": F.when(some, M.covered(e, F.array_distinct(F.flatten(chunks)))),
        "context_precision": F.when(some, M.context_precision(e, chunks)),
    })
    three = [F.col(x) for x in ("faithfulness", "relevance", "completeness")]
    kind = M.failure_type(*three, err)
    return out.withColumn("overall", (three[0] + three[1] + three[2]) / 3).withColumn("failure_type", kind).withColumn("passed", kind.isNull())


def exact_context_scores(samples: DataFrame, truth: str, contexts: str) -> DataFrame:
    """Adds exact_recall (share of the truth's words in all contexts) and keyword_precision (share of contexts with a word of more than three letters of the truth)."""
    t = F.array_distinct(split_tokens(F.col(truth)))
    cs = F.coalesce(F.transform(contexts, lambda c: F.array_distinct(split_tokens(c))), F.array().cast("array<array<string>>"))
    keys = F.filter(t, lambda w: F.length(w) > 3)
    n = F.size(cs)
    with_key = F.size(F.filter(cs, lambda c: F.arrays_overlap(c, keys)))
    precision = F.when(n == 0, F.lit(0.0)).when(F.size(keys) == 0, F.lit(1.0)).otherwise(with_key / F.when(n > 0, n))
    return samples.withColumn("exact_recall", M.covered(t, F.array_distinct(F.flatten(cs)))).withColumn("keyword_precision", precision)


def answer_scores(cases: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Adds token_f1, multiset_f1, judge_heuristic and judge_heuristic_correct (F1 of at least one half)."""
    p, t = plain_tokens(F.col(predicted)), plain_tokens(F.col(truth))
    f1 = M.token_f1(p, t)
    return cases.withColumn("token_f1", f1).withColumn("multiset_f1", M.multiset_f1(p, t)).withColumn("judge_heuristic", M.heuristic_score(f1)).withColumn("judge_heuristic_correct", f1 >= 0.5)


def hit_rate(retrieved: Column, truth: Column) -> Column:
    """1 if any retrieved id is a true one; nulls in either array don't count."""
    return F.coalesce(F.arrays_overlap(F.array_compact(retrieved), F.array_compact(truth)), F.lit(False)).cast("int")


SUMMARY_METRICS = ("faithfulness", "relevance", "completeness", "context_recall", "context_precision", "overall")


def summarize(results: DataFrame, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Per group, and in one rollup pass for the whole: n, pass_rate and the mean of each measure (nulls left out), rounded."""
    means = [F.round(F.avg(m), digits).alias(f"avg_{m}") for m in SUMMARY_METRICS if m in results.columns]
    aggregates = [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("passed").cast("int")), digits).alias("pass_rate"), *means]
    return (results.rollup(*by) if by else results.groupBy()).agg(*aggregates)


def failure_histogram(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed")).groupBy(F.coalesce("failure_type", F.lit("unknown")).alias("failure_type")).agg(F.count(F.lit(1)).alias("n"))


def unpivoted(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, value rows of a one-row summary."""
    return summary.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")


def gate(summary: DataFrame, minima: dict[str, float]) -> DataFrame:
    """The measures below their minimum: metric, value, minimum. No rows: the gate is open. Null values count as below."""
    limits = F.create_map(*[F.lit(x) for kv in minima.items() for x in kv])
    rows = unpivoted(summary, list(minima)).withColumn("minimum", F.element_at(limits, F.col("metric")))
    return rows.where(F.col("value").isNull() | (F.col("value") < F.col("minimum")))


def regressions(candidate: DataFrame, baseline: DataFrame, metrics: list[str], most: float = 0.05) -> DataFrame:
    """metric, candidate, baseline, delta (3 digits), is_regression (a fall of more than most)."""
    pair = unpivoted(candidate, metrics).withColumnRenamed("value", "candidate").join(unpivoted(baseline, metrics).withColumnRenamed("value", "baseline"), "metric")
    return pair.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 3)).withColumn("is_regression", F.col("delta") < -most)


def golden_faults(pairs: DataFrame, corpus: DataFrame | None = None, id_col: str = "id", question: str = "question", answer: str = "expected_answer", contexts: str | None = None, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """Faults of a golden set: id, fault ('no_id', 'duplicate_id', 'no_question', 'duplicate_question', 'no_answer', 'no_contexts', 'duplicate_context', 'unknown_source', 'not_in_source').

    contexts is an array of struct<source_doc, text>. Questions are the same if they
    are so apart from case and blanks. Duplicates are reported for every row but the
    first by id. Counts come from grouping, and the join back is salted, so a question
    that a third of all rows share is combined or spread before it moves.
    """
    base = pairs.withColumn("_key", question_key(F.col(question)))
    faults = [F.when(is_blank(F.col(id_col).cast("string")), "no_id"), F.when(is_blank(F.col(question)), "no_question"), F.when(is_blank(F.col(answer)), "no_answer")]
    if contexts:
        texts = F.transform(contexts, lambda c: c["text"])
        faults += [F.when(F.coalesce(F.size(contexts), F.lit(0)) < 1, "no_contexts"), F.when(F.size(F.array_distinct(texts)) < F.size(texts), "duplicate_context")]
    rows = base.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*faults))).alias("fault"))
    ids = pairs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("id").isNotNull()).select("id", F.lit("duplicate_id").alias("fault"))
    first = base.where(F.col("_key") != "").groupBy("_key").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # the rows of a question that many share spread over SALTS tasks
    salted = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    twice = base.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"]).where(F.col(id_col) != F.col("_first")).select(F.col(id_col).alias("id"), F.lit("duplicate_question").alias("fault"))
    out = rows.unionByName(ids).unionByName(twice)
    if contexts and corpus is not None:
        asked = pairs.select(F.col(id_col).alias("id"), F.explode(contexts).alias("c")).select("id", "c.source_doc", F.col("c.text").alias("snippet"))
        known = corpus.select(F.col(doc_id).cast("string").alias("source_doc"), F.col(doc_text).alias("_text"))
        found = asked.join(known, "source_doc", "left")
        fault = F.when(F.col("_text").isNull(), "unknown_source").when(~F.contains("_text", "snippet"), "not_in_source")
        out = out.unionByName(found.select("id", fault.alias("fault")).where(F.col("fault").isNotNull()))
    return out.distinct()


def strata(rows: DataFrame, column: str, minima: dict[str, int]) -> DataFrame:
    """Rows per stratum against its minimum: stratum, n, minimum, is_met. Labels are compared in lower case without blanks around; absent strata have n = 0."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k.lower(), v) for k, v in minima.items()], "stratum string, minimum int")
    counts = rows.groupBy(F.lower(strip(F.col(column))).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"), "minimum", (F.coalesce("n", F.lit(0)) >= F.col("minimum")).alias("is_met"))


def judge_biases(scores: DataFrame, order: str = "seq", score: str = "score", answer: str | None = None) -> DataFrame:
    """One row: n, mean_score, is_lenient (mean above 0.85), is_severe (below 0.35), is_positional (first half above the second by more than 0.20, from 4 rows), is_verbose (longer answers above shorter ones by more than 0.25, from 5 rows).

    order is a number of each row's place; it may have gaps. The first half is the
    n // 2 lowest, those below the exact median of the places, so the rows never come
    together; rows of one place fall into the same half.
    """
    middle = exact_quantiles(scores, [], order, (0.5,)).agg(F.max("value").alias("_mid"))
    stats = scores.agg(*([F.avg(F.size(split_tokens(F.col(answer)))).alias("_words")] if answer else [F.lit(None).alias("_words")]))
    rows = scores.crossJoin(stats).crossJoin(middle)  # one row each
    first = F.col(order) < F.col("_mid")
    longer = F.size(split_tokens(F.col(answer))) > F.col("_words") if answer else F.lit(None).cast("boolean")
    s = F.col(score)
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"),
        (F.avg(F.when(first, s)) - F.avg(F.when(~first, s))).alias("_halves"), (F.avg(F.when(longer, s)) - F.avg(F.when(~longer, s))).alias("_lengths"),
    )
    return out.select(
        "n", F.round("mean_score", 6).alias("mean_score"), (F.col("mean_score") > 0.85).alias("is_lenient"), (F.col("mean_score") < 0.35).alias("is_severe"),
        F.coalesce((F.col("n") >= 4) & (F.col("_halves") > 0.20), F.lit(False)).alias("is_positional"), F.coalesce((F.col("n") >= 5) & (F.col("_lengths") > 0.25), F.lit(False)).alias("is_verbose"),
        F.round("_halves", 6).alias("half_gap"), F.round("_lengths", 6).alias("length_gap"),
    )


def ab_delta(scores: DataFrame, variant: str, values: tuple[str, str], metrics: list[str]) -> DataFrame:
    """One row: the mean of each measure for both variants, and the second minus the first."""
    a, b = values
    means = scores.groupBy().pivot(variant, [a, b]).agg(*[F.avg(m).alias(m) for m in metrics]) if len(metrics) > 1 else scores.groupBy().pivot(variant, [a, b]).agg(F.avg(metrics[0]))
    name = (lambda v, m: f"{v}_{m}") if len(metrics) > 1 else (lambda v, m: v)  # Spark drops the measure's name if there is one
    return means.select(*[x for m in metrics for x in (F.col(name(a, m)).alias(f"{a}_{m}"), F.col(name(b, m)).alias(f"{b}_{m}"), (F.col(name(b, m)) - F.col(name(a, m))).alias(f"delta_{m}"))])


def numbered(rows: DataFrame, order: str, name: str = "n", ranges: int = 64) -> DataFrame:
    """Adds the place of each row, from 1, in order of a column (ties in any order), without sorting the rows in one task.

    A sample of the column gives bounds; ranges between them are numbered by
    themselves and moved on by the counts of the ranges before.
    """
    some = sorted(r[0] for r in drawn(rows.select(order).where(F.col(order).isNotNull()), 32 * ranges, rows.count(), 1).collect())  # a bounded sample
    bounds = [some[k * len(some) // ranges] for k in range(1, ranges)] if some else []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    cut = rows.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(at))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_c")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = cut.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    return inside.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_r", "_start", "_in")


#: What to do about failures, by their type in order of priority, then what is always worth doing.
REMEDIES = {
    "hallucination": "High Priority: Implement Factual Consistency Guardrail / Strict Context Grounding Prompt constraint.",
    "incomplete": "High Priority: Increase retrieval top-k window, enrich chunk overlap, and add structured few-shot examples.",
    "irrelevant": "Medium Priority: Refine query reformulation / intent routing step to preserve core user constraints.",
    "off_topic": "Medium Priority: Implement system prompt boundary enforcement and out-of-scope intent classifier.",
}
ALWAYS = ("Audit corpus document parsing for table and list truncation.", "Incorporate cross-encoder reranking to improve Context Precision AP@K.", "Tune system prompt temperature to <= 0.2 for deterministic adherence.")
HEALTHY = "Pipeline healthy. No remediation required."


def remediations(failures: DataFrame) -> DataFrame:
    """place (from 1), action: those of the failure types present in order of priority, filled up with the general ones to four; HEALTHY alone without failures."""
    kind = F.col("failure_type") if "failure_type" in failures.columns else F.lit("unknown")
    seen = failures.agg(F.coalesce(F.collect_set(kind), F.array().cast("array<string>")).alias("kinds"), F.count(F.lit(1)).alias("n"))  # a handful of types
    named = F.array_compact(F.array(*[F.when(F.array_contains("kinds", k), F.lit(v)) for k, v in REMEDIES.items()]))
    actions = F.when(F.col("n") == 0, F.array(F.lit(HEALTHY))).otherwise(F.concat(named, F.slice(F.array(*map(F.lit, ALWAYS)), F.lit(1), F.greatest(F.lit(0), F.lit(4) - F.size(named)))))
    return seen.select(F.posexplode(actions).alias("p", "action")).select((F.col("p") + 1).alias("place"), "action")


def numbered_failures(results: DataFrame, id_col: str) -> DataFrame:
    """Failed rows with a failure_id F001, F002, ... in order of id_col and the action of the same place, or else the first one."""
    failed = results.where(~F.col("passed"))
    actions = remediations(failed).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "action"))), lambda x: x["action"]).alias("_actions"))  # at most four
    rows = numbered(failed, id_col, "_n").crossJoin(actions)  # one row
    return rows.withColumn("failure_id", F.format_string("F%03d", "_n")).withColumn("action", F.coalesce(F.get("_actions", F.col("_n").cast("int") - 1), F.get("_actions", F.lit(0)))).drop("_n", "_actions")


def benchmark_report(scores: DataFrame, hit: str = "hit", rr: str = "rr", latency: str | None = None) -> DataFrame:
    """One row: n_queries, mean_hit, mean_rr (4 digits), mean_latency_ms (2 digits); zeros without queries."""
    mean = lambda c, d: F.round(F.coalesce(F.avg(c), F.lit(0.0)), d)
    return scores.agg(F.count(F.lit(1)).alias("n_queries"), mean(hit, 4).alias("mean_hit"), mean(rr, 4).alias("mean_rr"), (mean(latency, 2) if latency else F.lit(0.0)).alias("mean_latency_ms"))


def pipeline_report(scores: DataFrame, hit: str = "hit_rate", f1: str = "token_f1", judge: str = "judge_score", correct: str = "judge_correct", by: list[str] | None = None) -> DataFrame:
    """n, means of hit rate, F1 and judge score, and the share judged correct (4 digits); nulls are left out of each mean."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return (scores.groupBy(*by) if by else scores.groupBy()).agg(F.count(F.lit(1)).alias("n"), mean(hit).alias("mean_hit_rate"), mean(f1).alias("mean_token_f1"), mean(judge).alias("mean_judge_score"), F.round(F.avg(F.col(correct).cast("int")), 4).alias("judge_accuracy"))


def context_report(scores: DataFrame, recall: str = "exact_recall", precision: str = "keyword_precision", by: list[str] | None = None) -> DataFrame:
    """n, mean recall and precision of contexts (4 digits)."""
    return (scores.groupBy(*by) if by else scores.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(recall), 4).alias("mean_recall"), F.round(F.avg(precision), 4).alias("mean_precision"))
