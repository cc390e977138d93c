"""Evaluation, quality and fault-injection queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import metrics as M
from siltstone.functions import models
from siltstone.functions.text import STOPWORDS
from siltstone.operators import chaos as X
from siltstone.operators import evaluation as E
from siltstone.operators import quality as Q
from siltstone.operators import toolcalls as TC
from siltstone.session import stored, table
from siltstone.sources import files as FS
from siltstone.sources import store as ST

REFERENCE = "2000-01-01 00:00:00"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("case_id"), F.col("ground_truth_answer").alias("expected_answer"), F.trim("category").alias("category")).distinct()
    results = table(spark, d, "eval_results").select("result_id", "case_id", "question", F.col("generated_answer").alias("actual_answer"), "retrieved_contexts").distinct()
    return results.join(cases, "case_id")


def lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = E.evaluate_samples(_samples(spark, d), contexts="retrieved_contexts")
    return scored.select("result_id", *[F.round(c, 6).alias(c) for c in ("faithfulness", "relevance", "completeness", "context_recall")], "failure_type")


def context_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = E.exact_context_scores(E.evaluate_samples(_samples(spark, d), contexts="retrieved_contexts"), "expected_answer", "retrieved_contexts")
    return scored.select("result_id", *[F.round(c, 6).alias(c) for c in ("context_precision", "exact_recall", "keyword_precision")])


def summary_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Stored scores per category and overall, in one rollup."""
    rows = table(spark, d, "eval_results").select("result_id", "case_id", "faithfulness_score", "answer_relevance_score", "context_recall_score").distinct()
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("case_id"), F.trim("category").alias("category")).distinct()
    named = rows.join(cases, "case_id").withColumnsRenamed({"faithfulness_score": "faithfulness", "answer_relevance_score": "relevance", "context_recall_score": "context_recall"})
    return E.summarize(named.withColumn("passed", (F.col("faithfulness") >= 0.5) & (F.col("relevance") >= 0.5)), ["category"])


def answer_f1(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("test_id"), "ground_truth_answer").distinct()
    results = table(spark, d, "eval_test_results").select("result_key", "test_id", "predicted_answer").distinct()
    scored = E.answer_scores(results.join(cases, "test_id"), "predicted_answer", "ground_truth_answer")
    return scored.select("result_key", F.round("token_f1", 6).alias("f1"), F.round("judge_heuristic", 6).alias("judge"), "judge_heuristic_correct")


def golden_faults(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base as a golden set: each text's own beginning and its title as contexts from it; deleted documents are no sources."""
    kb = table(spark, d, "kb_docs").select(F.col("ingest_id").alias("id"), F.try_element_at("metadata", F.lit("title")).alias("question"), "content", "deleted_at").distinct()
    context = lambda text: F.struct(F.col("id").alias("source_doc"), text.alias("text"))
    pairs = kb.withColumn("contexts", F.when(F.col("content").isNotNull(), F.array(context(F.substring("content", 5, 30)), context(F.coalesce("question", F.lit(""))))))
    corpus = kb.where(F.col("deleted_at").isNull() & F.col("content").isNotNull()).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    return E.golden_faults(pairs, corpus, answer="content", contexts="contexts")


def golden_questions(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the evaluation cases as they are."""
    cases = table(spark, d, "eval_cases").select("id", "question", "ground_truth_answer").distinct()
    return E.golden_faults(cases, answer="ground_truth_answer")


def category_strata(spark: SparkSession, d: str) -> DataFrame:
    return E.strata(table(spark, d, "eval_cases").select("id", "category").distinct(), "category", {"ops": 100, "general": 100, "search": 100, "absent": 1})


def judge_biases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_test_results").select("result_key", "judge_score", "predicted_answer").distinct()
    numbered = rows.withColumn("seq", F.expr("try_cast(regexp_extract(result_key, '([0-9]+)$', 1) AS bigint)")).withColumn("score", (F.col("judge_score") - 1) / 4)
    return E.judge_biases(numbered, "seq", "score", "predicted_answer")


def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Scores read back from a judge's replies, with talk around the object, a missing criterion and unreadable values."""
    rows = table(spark, d, "eval_test_results").select("result_key", "judge_score", "judge_correct").distinct()
    reply = F.concat(F.lit("Verdict: {\"accuracy\": "), F.coalesce(F.col("judge_score").cast("string"), F.lit("\"none\"")), F.lit(", \"tone\": "), F.when(F.col("judge_correct"), "7").otherwise("0"), F.lit("} as asked."))
    scores = models.judge_scores(F.when(F.col("judge_correct").isNotNull(), reply).otherwise("no verdict"), ["accuracy", "tone", "brevity"])
    return rows.select("result_key", scores.alias("s")).select("result_key", F.round("s.accuracy", 6).alias("accuracy"), F.round("s.tone", 6).alias("tone"), F.round("s.brevity", 6).alias("brevity"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation results with their stored scores (null counts as 0), category and failure type."""
    rows = table(spark, d, "eval_results").select("result_id", "case_id", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in (("faithfulness", "faithfulness_score"), ("relevance", "answer_relevance_score"), ("completeness", "context_recall_score"), ("context_precision", "context_precision_score"))]).distinct()
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("case_id"), F.trim("category").alias("category")).distinct()
    out = rows.join(cases, "case_id").withColumn("context_recall", F.col("completeness"))
    kind = M.failure_type(F.col("faithfulness"), F.col("relevance"), F.col("completeness"), F.lit(None))
    return out.withColumn("failure_type", kind).withColumn("passed", kind.isNull())


def failure_log(spark: SparkSession, d: str) -> DataFrame:
    """Failed results numbered, with their cause and what to do."""
    rows = stored(_stored(spark, d), "scores")
    cause = M.root_cause(*[F.col(c) for c in ("faithfulness", "relevance", "completeness", "context_recall", "context_precision")], F.lit(None))
    return E.numbered_failures(rows.withColumn("cause", cause), "result_id").select("failure_id", "result_id", "failure_type", "cause", "action")


def failure_types(spark: SparkSession, d: str) -> DataFrame:
    return E.failure_histogram(_stored(spark, d))


def remedies(spark: SparkSession, d: str) -> DataFrame:
    """What to do about the failures of one category."""
    return E.remediations(_stored(spark, d).where(~F.col("passed") & (F.col("category") == "ops")))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    """Operations as the candidate, search as the baseline: changes of the means, and those below their minimum."""
    rows = _stored(spark, d)
    names = ["pass_rate", "avg_faithfulness", "avg_relevance", "avg_completeness"]
    candidate, baseline = (E.summarize(rows.where(F.col("category") == c)) for c in ("ops", "search"))
    below = E.gate(candidate, {"pass_rate": 0.8, "avg_faithfulness": 0.7, "avg_relevance": 0.7}).select("metric", F.lit(True).alias("is_below"))
    return E.regressions(candidate, baseline, names, 0.005).join(below, "metric", "left").withColumn("is_below", F.coalesce("is_below", F.lit(False)))


def judge_ab(spark: SparkSession, d: str) -> DataFrame:
    """Answers judged wrong against those judged right."""
    rows = table(spark, d, "eval_test_results").select("result_key", "hit_rate", "token_f1", F.col("judge_correct").cast("string").alias("variant")).distinct()
    out = E.ab_delta(rows, "variant", ("false", "true"), ["hit_rate", "token_f1"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_test_results").select("result_key", "test_id", "hit_rate", "token_f1", "judge_score", "judge_correct").distinct()
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("test_id"), F.trim("category").alias("category")).distinct()
    return E.pipeline_report(rows.join(cases, "test_id"), by=["category"])


def report_json(spark: SparkSession, d: str) -> DataFrame:
    """The stored scores per category as JSON, relevance with two digits."""
    return FS.serialized(_stored(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("faithfulness").alias("faithfulness"), F.avg("relevance").alias("relevance"), F.max(F.when(F.col("category") == "ops", "yes")).alias("ops")), 4, {"relevance": 2})


def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """The gate's Markdown report, line by line."""
    lines = FS.gate_markdown(document_gate(spark, d)).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


def context_report(spark: SparkSession, d: str) -> DataFrame:
    return E.context_report(E.exact_context_scores(_samples(spark, d), "expected_answer", "retrieved_contexts"), by=["category"])


def id_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether a test retrieved any true document, null and repeated ids aside."""
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("test_id"), "ground_truth_doc_ids").distinct()
    rows = table(spark, d, "eval_test_results").select("result_key", "test_id", "retrieved_doc_ids").distinct().join(cases, "test_id")
    return rows.select("result_key", E.hit_rate(F.col("retrieved_doc_ids"), F.col("ground_truth_doc_ids")).alias("hit"))


def answer_bags(spark: SparkSession, d: str) -> DataFrame:
    """The usual token F1, in which repeated words count as often as both have them."""
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("test_id"), "ground_truth_answer").distinct()
    rows = table(spark, d, "eval_test_results").select("result_key", "test_id", "predicted_answer").distinct()
    return E.answer_scores(rows.join(cases, "test_id"), "predicted_answer", "ground_truth_answer").select("result_key", F.round("multiset_f1", 6).alias("f1"))


def document_gate(spark: SparkSession, d: str) -> DataFrame:
    rules = Q.GateRules(1, 100_000_000_000, ("doc_id", "text", "source", "gone"), ("doc_id", "text"), {"text": 20}, {"counted": "n_chars = length(text)"})
    return Q.quality_gate(table(spark, d, "documents"), rules)


def order_freshness(spark: SparkSession, d: str) -> DataFrame:
    return Q.freshness(table(spark, d, "orders"), "o_orderdate", F.lit(REFERENCE), 1800.0, 0.5, ["o_orderstatus"])


def fault_sample(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return X.truncate_title(orders, "o_orderpriority", "o_orderkey")


def latest_dropped(spark: SparkSession, d: str) -> DataFrame:
    return X.drop_latest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey")


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return Q.verdict(document_gate(spark, d))


def document_check(spark: SparkSession, d: str) -> DataFrame:
    """First fault of every chunk."""
    return Q.document_faults(table(spark, d, "kb_docs").select("ingest_id", "content", "metadata", "created_at").withColumn("place", F.col("created_at").cast("bigint")), "ingest_id", index="place").distinct()


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", F.col("o_totalprice"))


def fault_plan(spark: SparkSession, d: str) -> DataFrame:
    """All faults in sequence over the orders."""
    broken, _ = X.inject(_orders(spark, d).drop("o_totalprice"), "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    return broken


def fault_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = X.inject(_orders(spark, d).drop("o_totalprice"), "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    return report


def _broken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return orders, X.duplicate_rows(X.blank_text(orders, "o_orderpriority", "o_orderkey"), "o_orderkey")


def repair_audit(spark: SparkSession, d: str) -> DataFrame:
    """Clean, corrupted and replayed orders through the same counts."""
    orders, broken = _broken(spark, d)
    replayed = X.latest_versions(broken.unionByName(orders), "o_orderkey", "o_orderpriority")
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("n_duplicates"), F.count_if(F.col("o_orderpriority") == "").alias("n_blank"))
    return X.compare_states({"clean": state(orders), "corrupted": state(broken), "repaired": state(replayed)}, ["n_rows", "n_duplicates", "n_blank"])


def audit_states(spark: SparkSession, d: str) -> DataFrame:
    """Gate and freshness of the orders, clean, corrupted and repaired."""
    orders = _orders(spark, d)
    broken, _ = X.inject(orders, "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    broken = broken.withColumn("o_orderdate", F.try_to_timestamp("o_orderdate").cast("timestamp_ntz"))
    repaired = X.latest_versions(orders.unionByName(orders), "o_orderkey", "o_orderdate")
    rules = Q.GateRules(1, None, ("o_orderkey",), ("o_orderkey",), {"o_orderpriority": 3})
    look = lambda df: (df, Q.quality_gate(df, rules), Q.freshness(df, "o_orderdate", F.lit(REFERENCE), 1700.0, 0.5))
    return X.audit({"clean": look(orders), "corrupted": look(broken), "repaired": look(repaired)})


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """The audit's Markdown report, line by line."""
    lines = FS.audit_markdown(audit_states(spark, d)).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


def improvement_log(spark: SparkSession, d: str) -> DataFrame:
    """Markdown lines of the failures of one category that are hallucinations."""
    rows = stored(_stored(spark, d), "scores").where((F.col("category") == "ops") & (F.col("faithfulness") < 0.1))
    cause = M.root_cause(*[F.col(c) for c in ("faithfulness", "relevance", "completeness", "context_recall", "context_precision")], F.lit(None))
    lines = FS.improvement_markdown(E.numbered_failures(rows.withColumn("root_cause", cause), "result_id"), "result_id").split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that ask a judge for scores, and what a plugged-in embedding model makes of them."""
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("test_id"), "question", "ground_truth_answer").distinct()
    rows = table(spark, d, "eval_test_results").select("result_key", "test_id", "predicted_answer").distinct().join(cases, "test_id")
    prompt = models.judge_prompt(F.col("question"), F.col("predicted_answer"), F.col("ground_truth_answer"), ["accuracy", "tone"])
    embed = models.embedder(lambda: lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts])
    out = rows.select("result_key", prompt.alias("prompt")).withColumn("v", embed(F.col("prompt")))
    return out.select("result_key", F.md5("prompt").alias("digest"), F.col("v")[0].alias("n_chars"), F.col("v")[1].alias("n_blanks"))


def replay_result(spark: SparkSession, d: str) -> DataFrame:
    """The corrupted orders replayed into a store that holds them: cleaned of repeats and blanks, through the gate, twice."""
    orders, broken = _broken(spark, d)
    clean = lambda df: X.quarantine(df, F.col("o_orderpriority") != "")[0].dropDuplicates(["o_orderkey"])
    gate = lambda df: Q.quality_gate(df, Q.GateRules(1, None, ("o_orderkey",), ("o_orderkey",)))
    once, result = X.replayed(broken.unionByName(orders), orders, clean, gate, "o_orderkey")
    twice, _ = X.replayed(broken.unionByName(orders), once, clean, gate, "o_orderkey")
    return result.crossJoin(twice.agg(F.count(F.lit(1)).alias("n_stored"), F.count_distinct("o_orderkey").alias("n_ids")))  # one row each


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the knowledge base that meet the rules and rows that don't."""
    good, bad = X.quarantine(table(spark, d, "kb_docs").select("ingest_id", "content", "created_at").distinct(), (F.length("content") > 200) & (F.col("created_at") < 1e11))
    return good.select("ingest_id", F.lit("good").alias("side")).unionByName(bad.select("ingest_id", F.lit("quarantine").alias("side")))


def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store after an append, an upsert and the deletion of a document: rows, ids and vectors per language."""
    rows = table(spark, d, "chunks").select("id", "parent_doc_id", "content", "chunk_index", F.map_filter("metadata", lambda k, v: k == "lang").alias("metadata"), "ingested_at").where(F.col("id").isNotNull())
    ready = ST.records(rows.drop("ingested_at").dropDuplicates(["id"]))
    changed = ready.where(F.col("chunk_index") == 0).withColumn("content", F.lit("changed"))
    kept = ST.delete_document(ST.upsert(ST.append(ready, ready.where(F.col("chunk_index") == 1)), changed.unionByName(changed)), "doc-100000009")
    return kept.groupBy("chunk_index").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("content") == "changed").alias("n_changed"), F.count_if(F.size("embedding") == 64).alias("n_vectors"))


def store_size(spark: SparkSession, d: str) -> DataFrame:
    return ST.size(table(spark, d, "chunks"))


def prompt_versions(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base as a prompt registry (a version per ingestion, those not deleted in production): what is served after a promotion and its rollback."""
    w = Window.partitionBy("id").orderBy(F.coalesce("created_at", F.lit(0.0)), "ingest_id")
    rows = table(spark, d, "kb_docs").select("id", "ingest_id", "content", "created_at", "deleted_at").dropDuplicates(["ingest_id"]).withColumn("version", F.row_number().over(w))
    registry = rows.select(F.col("id").alias("name"), "version", F.coalesce("content", F.lit("")).alias("template"), F.when(F.col("deleted_at").isNull(), F.array(F.lit("production"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    served = models.resolve_prompts(models.rollback(models.promote(registry, "doc-100000009", 1), "doc-100000009"), fallback={"spare": "Answer briefly."})
    return served.select("name", "version", F.md5("template").alias("digest"))


def newest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Newest version of every knowledge-base id."""
    rows = table(spark, d, "kb_docs").withColumn("version", F.coalesce("created_at", F.lit(0.0))).drop("metadata")
    return X.latest_versions(rows, "id", "version").select("id", F.round("version", 3).alias("version"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """A test's retrieval as tool calls that must ask for the true documents; by the test's number some calls are missing, repeated, misnamed or not wanted at all."""
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("test_id"), F.array_compact("ground_truth_doc_ids").alias("truth")).distinct()
    results = table(spark, d, "eval_test_results").select("result_key", "test_id", "retrieved_doc_ids").distinct().join(cases, "test_id")
    kind = F.expr("try_cast(regexp_extract(result_key, '([0-9]+)$', 1) AS bigint) % 8").alias("kind")
    call = lambda name, ids: F.struct(F.lit(name).alias("name"), F.struct(ids.alias("ids")).alias("args"))
    got = call("search", F.col("retrieved_doc_ids"))
    empty = F.array().cast("array<struct<name:string,args:struct<ids:array<string>>>>")
    actual = F.when(F.col("kind") == 0, F.array(got, call("lookup", F.col("truth")))).when(F.col("kind") == 1, empty).when(F.col("kind") == 2, F.array(got, call("search", F.col("truth")))).when(F.col("kind") == 3, F.array(call("find", F.col("truth")))).otherwise(F.array(got))
    rows = results.withColumn("kind", kind)
    return rows.select("result_key", "kind", TC.graded(F.to_json(F.array(call("search", F.col("truth")))), F.to_json(actual), F.col("kind") == 4).alias("grade"))


def tool_grades(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the suite per kind of planted call."""
    return TC.suite(_graded(spark, d), by=["kind"])


def tool_failures(spark: SparkSession, d: str) -> DataFrame:
    return TC.failure_types(_graded(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_scores, context_scores, summary_by_category, answer_f1, answer_bags, golden_faults, golden_questions, category_strata, judge_biases, judge_parse, failure_log, failure_types, remedies, release_gate, judge_ab,
        pipeline_report, report_json, gate_report, context_report, id_overlap, document_gate, gate_verdict, document_check, order_freshness, fault_sample, fault_plan, fault_report, latest_dropped, repair_audit, audit_states, audit_report, improvement_log, judge_prompts, replay_result, quarantined,
        newest_documents, store_changes, store_size, prompt_versions, tool_grades, tool_failures,
    )
}

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_B = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANK = f"({{c}} IS NULL OR regexp_replace({{c}}, '^{_B}+|{_B}+$', '', 'g') = '')"
_TOK = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+'), lambda w: NOT list_contains({stop}, w)))"
_RANK = "row_number() OVER (ORDER BY md5(o_orderkey || '|{seed}'), o_orderkey) <= round_even({f} * count(*) OVER (), 0)"


_SPLIT = rf"list_filter(regexp_split_to_array(lower(coalesce({{c}}, '')), '{_B}+'), lambda w: w <> '')"
_PLAIN = rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({{c}}, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s\x{{a0}}]', ' ', 'g'), '{_B}+'), lambda w: w <> '')"
_PLAIN = _PLAIN.replace("{{", "{").replace("}}", "}")
_SCORED = """
WITH e AS (SELECT DISTINCT result_id, case_id, coalesce(faithfulness_score, 0) AS f, coalesce(answer_relevance_score, 0) AS r, coalesce(context_recall_score, 0) AS c, coalesce(context_precision_score, 0) AS p FROM eval_results),
s AS (SELECT e.*, k.category, CASE WHEN f >= 0.5 AND r >= 0.5 AND c >= 0.5 THEN NULL WHEN f < 0.3 THEN 'hallucination' WHEN r < 0.3 THEN 'irrelevant' WHEN c < 0.3 THEN 'incomplete' ELSE 'off_topic' END AS kind FROM e JOIN (SELECT DISTINCT id AS case_id, trim(category) AS category FROM eval_cases) k USING (case_id))
"""
_GRADED = """
WITH c AS (SELECT DISTINCT id AS test_id, list_transform(list_filter(ground_truth_doc_ids, lambda x: x IS NOT NULL), lambda x: lower(trim(x))) AS t FROM eval_cases),
b AS (SELECT TRY_CAST(regexp_extract(result_key, '([0-9]+)$', 1) AS BIGINT) % 8 AS kind, t IS NULL OR list_has_all(list_transform(list_filter(retrieved_doc_ids, lambda x: x IS NOT NULL), lambda x: lower(trim(x))), t) AS ok FROM (SELECT DISTINCT result_key, test_id, retrieved_doc_ids FROM eval_test_results) JOIN c USING (test_id)),
g AS (SELECT kind, kind NOT IN (0, 1, 2, 3, 4) AS routed, CASE WHEN kind IN (1, 3, 4) THEN false WHEN kind = 2 THEN true ELSE ok END AS args, kind IN (0, 2, 3, 4) AS extra FROM b)
"""
_PLAN = """
WITH k AS (SELECT * FROM (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS t, o_orderdate AS w, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn, count(*) OVER () AS b FROM orders) WHERE rn > greatest(1, floor(0.2 * b))),
y AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r42, row_number() OVER (ORDER BY md5(o_orderkey || '|43'), o_orderkey) AS r43, row_number() OVER (ORDER BY md5(o_orderkey || '|44'), o_orderkey) AS r44, row_number() OVER (ORDER BY md5(o_orderkey || '|45'), o_orderkey) AS r45, row_number() OVER (ORDER BY md5(o_orderkey || '|46'), o_orderkey) AS r46 FROM k),
z AS (SELECT o_orderkey, n, r46, CASE WHEN r42 <= round_even(0.15 * n, 0) THEN '' ELSE p END || CASE WHEN r43 <= round_even(0.15 * n, 0) THEN repeat(' ###NOISE###', 3) ELSE '' END AS p,
  CASE WHEN r44 <= round_even(0.15 * n, 0) THEN substring(t, 1, 6) ELSE t END AS t, CASE WHEN r45 <= round_even(0.25 * n, 0) THEN strftime(w - INTERVAL 365 DAY, '%Y-%m-%d') ELSE CAST(w AS VARCHAR) END AS w FROM y)
"""


def _cover(part: str, by: str) -> str:
    return f"CASE WHEN len({part}) = 0 THEN 1.0 ELSE len(list_intersect({part}, {by})) / len({part})::DOUBLE END"


SQL = {
    "lexical_scores": f"""
WITH c AS (SELECT DISTINCT id AS case_id, ground_truth_answer AS e FROM eval_cases), r AS (SELECT DISTINCT result_id, case_id, question AS q, generated_answer AS a, retrieved_contexts AS x FROM eval_results),
t AS (SELECT result_id, {_TOK.format(c='q', stop=_STOP)} AS q, {_TOK.format(c='a', stop=_STOP)} AS a, {_TOK.format(c='e', stop=_STOP)} AS e, {_TOK.format(c="array_to_string(x, chr(10))", stop=_STOP)} AS g, len(x) > 0 AS has_x FROM r JOIN c USING (case_id)),
m AS (SELECT result_id, CASE WHEN has_x THEN {_cover('a', 'g')} ELSE {_cover('a', 'e')} END AS f, {_cover('q', 'a')} AS r, {_cover('e', 'a')} AS c, CASE WHEN has_x THEN {_cover('e', 'g')} END AS cr FROM t)
SELECT result_id, round(f, 6) AS faithfulness, round(r, 6) AS relevance, round(c, 6) AS completeness, round(cr, 6) AS context_recall,
  CASE WHEN f >= 0.5 AND r >= 0.5 AND c >= 0.5 THEN NULL WHEN f < 0.3 THEN 'hallucination' WHEN r < 0.3 THEN 'irrelevant' WHEN c < 0.3 THEN 'incomplete' ELSE 'off_topic' END AS failure_type FROM m
""",
    "summary_by_category": """
WITH r AS (SELECT DISTINCT result_id, case_id, faithfulness_score AS f, answer_relevance_score AS r, context_recall_score AS c FROM eval_results), k AS (SELECT DISTINCT id AS case_id, trim(category) AS category FROM eval_cases)
SELECT category, count(*)::BIGINT AS n, round(avg(CASE WHEN f >= 0.5 AND r >= 0.5 THEN 1 WHEN f < 0.5 OR r < 0.5 THEN 0 END), 3) AS pass_rate, round(avg(f), 3) AS avg_faithfulness, round(avg(r), 3) AS avg_relevance, round(avg(c), 3) AS avg_context_recall
FROM r JOIN k USING (case_id) GROUP BY ROLLUP (category)
""",
    "answer_f1": rf"""
WITH c AS (SELECT DISTINCT id AS test_id, ground_truth_answer AS g FROM eval_cases), r AS (SELECT DISTINCT result_key, test_id, predicted_answer AS p FROM eval_test_results),
t AS (SELECT result_key, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(p, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s\x{{a0}}]', ' ', 'g'), '{_B}+'), lambda w: w <> '') AS p,
  list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(g, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s\x{{a0}}]', ' ', 'g'), '{_B}+'), lambda w: w <> '') AS g FROM r JOIN c USING (test_id)),
f AS (SELECT result_key, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(list_distinct(p), list_distinct(g))) / (len(p) + len(g)) END AS f FROM t)
SELECT result_key, round(f, 6) AS f1, round(1 + least(4.0, 4 * f), 6) AS judge, f >= 0.5 AS judge_heuristic_correct FROM f
""",
    "golden_questions": f"""
WITH c AS (SELECT DISTINCT id, question, ground_truth_answer AS a FROM eval_cases), k AS (SELECT *, lower(trim(regexp_replace(question, '{_B}+', ' ', 'g'))) AS key FROM c),
n AS (SELECT key, min(id) AS first FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1)
SELECT id, 'no_answer' AS fault FROM c WHERE a IS NULL OR regexp_replace(a, '^{_B}+|{_B}+$', '', 'g') = ''
UNION SELECT id, 'no_question' FROM c WHERE question IS NULL OR regexp_replace(question, '^{_B}+|{_B}+$', '', 'g') = ''
UNION SELECT id, 'duplicate_id' FROM c GROUP BY id HAVING count(*) > 1
UNION SELECT id, 'duplicate_question' FROM k JOIN n USING (key) WHERE id <> first
""",
    "golden_faults": f"""
WITH k AS (SELECT DISTINCT ingest_id AS id, metadata['title'] AS q, content AS a, deleted_at FROM kb_docs), x AS (SELECT *, CASE WHEN a IS NOT NULL THEN [substring(a, 5, 30), coalesce(q, '')] END AS c, {_BLANK.replace('{c}', 'q')} AS bq, {_BLANK.replace('{c}', 'a')} AS ba FROM k),
m AS (SELECT *, lower(trim(regexp_replace(q, '{_B}+', ' ', 'g'))) AS key FROM x), n AS (SELECT key, min(id) AS first FROM m WHERE key <> '' GROUP BY key HAVING count(*) > 1),
s AS (SELECT DISTINCT id, unnest(c) AS t FROM x), src AS (SELECT id, a FROM x WHERE deleted_at IS NULL AND a IS NOT NULL)
SELECT id, 'no_question' AS fault FROM x WHERE bq UNION SELECT id, 'no_answer' FROM x WHERE ba UNION SELECT id, 'no_contexts' FROM x WHERE c IS NULL UNION SELECT id, 'duplicate_context' FROM x WHERE c[1] = c[2]
UNION SELECT id, 'duplicate_id' FROM x GROUP BY id HAVING count(*) > 1 UNION SELECT id, 'duplicate_question' FROM m JOIN n USING (key) WHERE id <> first
UNION SELECT s.id, 'unknown_source' FROM s LEFT JOIN src ON s.id = src.id WHERE src.id IS NULL UNION SELECT s.id, 'not_in_source' FROM s JOIN src ON s.id = src.id WHERE NOT contains(src.a, s.t)
""",
    "category_strata": """
WITH w(stratum, minimum) AS (VALUES ('ops', 100), ('general', 100), ('search', 100), ('absent', 1)), c AS (SELECT lower(trim(category)) AS stratum, count(*) AS n FROM (SELECT DISTINCT id, category FROM eval_cases) GROUP BY 1)
SELECT stratum, coalesce(n, 0)::BIGINT AS n, minimum::INTEGER AS minimum, coalesce(n, 0) >= minimum AS is_met FROM w LEFT JOIN c USING (stratum)
""",
    "document_gate": """
SELECT 'row_count' AS rule, NULL::VARCHAR AS column_name, 'BLOCKER' AS severity, count(*) >= 1 AS passed, count(*)::BIGINT AS observed FROM documents
UNION ALL SELECT 'not_null', c, 'BLOCKER', n = 0, n FROM (SELECT 'doc_id' AS c, count(*) FILTER (doc_id IS NULL) AS n FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents)
UNION ALL SELECT 'not_null', 'gone', 'BLOCKER', false, count(*) FROM documents
UNION ALL SELECT 'unique', c, 'BLOCKER', n = 0, n FROM (SELECT 'doc_id' AS c, count(*) - count(DISTINCT doc_id) - max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n FROM documents UNION ALL SELECT 'text', count(*) - count(DISTINCT text) - max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) FROM documents)
UNION ALL SELECT 'min_length', 'text', 'WARNING', n = 0, n FROM (SELECT count(*) FILTER (coalesce(length(text), 0) < 20) AS n FROM documents)
UNION ALL SELECT 'custom:counted', NULL, 'WARNING', n = 0, n FROM (SELECT count(*) FILTER (NOT coalesce(n_chars = length(text), false)) AS n FROM documents)
""",
    "order_freshness": f"""
WITH o AS (SELECT o_orderstatus, date_diff('microsecond', o_orderdate, TIMESTAMP '{REFERENCE}') / 86400e6 AS age FROM orders)
SELECT o_orderstatus, count(*)::BIGINT AS n, count(age)::BIGINT AS n_valid, count(*) FILTER (age > 1800)::BIGINT AS n_stale, round(count(*) FILTER (age > 1800) / count(*)::DOUBLE, 4) AS stale_ratio,
  count(*) FILTER (age > 1800) / count(*)::DOUBLE <= 0.5 AS is_fresh, round(min(age), 4) AS min_age_days, round(max(age), 4) AS max_age_days, round(median(age), 4) AS median_age_days FROM o GROUP BY 1
""",
    "fault_sample": f"SELECT o_orderkey, CASE WHEN {_RANK.format(seed=44, f=0.15)} THEN substring(o_orderpriority, 1, 6) ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "latest_dropped": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn, count(*) OVER () AS n FROM orders) WHERE rn > greatest(1, floor(0.2 * n))",
    "newest_documents": "SELECT id, round(max(coalesce(created_at, 0)), 3) AS version FROM kb_docs GROUP BY id",
    "tool_grades": _GRADED + """
SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (routed AND args)::BIGINT AS n_passed, round(avg((routed AND args)::INTEGER), 4) AS pass_rate, round(avg(routed::INTEGER), 4) AS routing_accuracy, round(avg(args::INTEGER), 4) AS args_accuracy,
  round(avg((NOT routed)::INTEGER), 4) AS extra_calls_rate, round(avg(extra::INTEGER), 4) AS unsolicited_rate FROM g GROUP BY kind
""",
    "tool_failures": _GRADED + "SELECT CASE WHEN kind = 4 THEN 'unexpected_tool_call' WHEN NOT routed THEN 'wrong_tool_or_count' ELSE 'wrong_argument_values' END AS failure_type, count(*)::BIGINT AS n FROM g WHERE NOT (routed AND args) GROUP BY 1",
    "context_scores": f"""
WITH c AS (SELECT DISTINCT id AS case_id, ground_truth_answer AS e FROM eval_cases), r AS (SELECT DISTINCT result_id, case_id, retrieved_contexts AS x FROM eval_results),
t AS (SELECT result_id, {_TOK.format(c='e', stop=_STOP)} AS e, list_distinct({_SPLIT.replace('{c}', 'e')}) AS w, x, list_filter(list_distinct({_SPLIT.replace('{c}', 'e')}), lambda k: length(k) > 3) AS keys FROM r JOIN c USING (case_id)),
u AS (SELECT result_id, e, keys, unnest(x) AS ctx, generate_subscripts(x, 1) AS pos FROM t),
v AS (SELECT result_id, pos, CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_intersect(e, {_TOK.format(c='ctx', stop=_STOP)})) / len(e)::DOUBLE END >= 0.1 AS rel, len(list_intersect(list_distinct({_SPLIT.replace('{c}', 'ctx')}), keys)) > 0 AS has_key FROM u),
h AS (SELECT *, sum(rel::INTEGER) OVER (PARTITION BY result_id ORDER BY pos) / pos::DOUBLE AS p FROM v),
a AS (SELECT result_id, count(*) AS n, sum(rel::INTEGER) AS hits, sum(CASE WHEN rel THEN p ELSE 0 END) AS total, sum(has_key::INTEGER) AS k FROM h GROUP BY 1)
SELECT result_id, round(CASE WHEN coalesce(len(x), 0) = 0 THEN NULL WHEN len(e) = 0 THEN 1.0 WHEN hits > 0 THEN total / hits ELSE 0.0 END, 6) AS context_precision,
  round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_intersect(w, list_distinct({_SPLIT.replace('{c}', "array_to_string(x, ' ')")}))) / len(w)::DOUBLE END, 6) AS exact_recall,
  round(CASE WHEN coalesce(len(x), 0) = 0 THEN 0.0 WHEN len(keys) = 0 THEN 1.0 ELSE k / n::DOUBLE END, 6) AS keyword_precision FROM t LEFT JOIN a USING (result_id)
""",
    "context_report": f"""
WITH c AS (SELECT DISTINCT id AS case_id, ground_truth_answer AS e, trim(category) AS category FROM eval_cases), r AS (SELECT DISTINCT result_id, case_id, question, generated_answer, retrieved_contexts AS x FROM eval_results),
t AS (SELECT result_id, category, list_distinct({_SPLIT.replace('{c}', 'e')}) AS w, x FROM r JOIN c USING (case_id)),
f AS (SELECT category, CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_intersect(w, list_distinct({_SPLIT.replace('{c}', "array_to_string(x, ' ')")}))) / len(w)::DOUBLE END AS rec,
  CASE WHEN coalesce(len(x), 0) = 0 THEN 0.0 WHEN len(list_filter(w, lambda k: length(k) > 3)) = 0 THEN 1.0 ELSE len(list_filter(x, lambda y: len(list_intersect(list_distinct({_SPLIT.replace('{c}', 'y')}), list_filter(w, lambda k: length(k) > 3))) > 0)) / len(x)::DOUBLE END AS prec FROM t)
SELECT category, count(*)::BIGINT AS n, round(avg(rec), 4) AS mean_recall, round(avg(prec), 4) AS mean_precision FROM f GROUP BY 1
""",
    "judge_biases": f"""
WITH r AS (SELECT TRY_CAST(regexp_extract(result_key, '([0-9]+)$', 1) AS BIGINT) AS seq, (judge_score - 1) / 4 AS s, len({_SPLIT.replace('{c}', 'predicted_answer')}) AS w FROM (SELECT DISTINCT result_key, judge_score, predicted_answer FROM eval_test_results)),
m AS (SELECT median(seq::DOUBLE) AS mid, avg(w) AS words, count(*) AS n FROM r),
g AS (SELECT any_value(n) AS n, avg(s) AS mean, avg(s) FILTER (seq < mid) - avg(s) FILTER (seq >= mid) AS halves, avg(s) FILTER (w > words) - avg(s) FILTER (NOT w > words) AS lengths FROM r, m)
SELECT n::BIGINT AS n, round(mean, 6) AS mean_score, mean > 0.85 AS is_lenient, mean < 0.35 AS is_severe, coalesce(n >= 4 AND halves > 0.2, false) AS is_positional, coalesce(n >= 5 AND lengths > 0.25, false) AS is_verbose, round(halves, 6) AS half_gap, round(lengths, 6) AS length_gap FROM g
""",
    "judge_parse": """
WITH r AS (SELECT DISTINCT result_key, judge_score AS s, judge_correct AS c FROM eval_test_results)
SELECT result_key, round(CASE WHEN c IS NULL OR s IS NULL THEN 0.5 ELSE least(1, greatest(0, (s - 1) / 4)) END, 6)::DOUBLE AS accuracy, CASE WHEN c IS NULL THEN 0.5 WHEN c THEN 1.0 ELSE 0.0 END::DOUBLE AS tone, 0.5::DOUBLE AS brevity FROM r
""",
    "failure_log": _SCORED + f"""
, a AS (SELECT list_filter([{', '.join(f"CASE WHEN count(*) FILTER (kind = '{k}') > 0 THEN '{v}' END" for k, v in E.REMEDIES.items())}], lambda x: x IS NOT NULL) AS n FROM s WHERE kind IS NOT NULL),
b AS (SELECT list_concat(n, list_slice([{', '.join(f"'{v}'" for v in E.ALWAYS)}], 1, greatest(0, 4 - len(n)))) AS n FROM a),
f AS (SELECT *, row_number() OVER (ORDER BY result_id) AS k, least(f, r, c) AS low FROM s WHERE kind IS NOT NULL)
SELECT printf('F%03d', k) AS failure_id, result_id, kind AS failure_type, CASE WHEN c < 0.3 THEN 'recall' WHEN p < 0.2 THEN 'ranking' WHEN (abs(f - low) < 1e-4)::INTEGER + (abs(r - low) < 1e-4)::INTEGER + (abs(c - low) < 1e-4)::INTEGER > 1 THEN 'compound'
  WHEN abs(f - low) < 1e-4 THEN 'groundedness' WHEN abs(r - low) < 1e-4 THEN 'relevance' ELSE 'completeness' END AS cause, coalesce(b.n[k], b.n[1]) AS action FROM f, b
""",
    "failure_types": _SCORED + "SELECT kind AS failure_type, count(*)::BIGINT AS n FROM s WHERE kind IS NOT NULL GROUP BY 1",
    "remedies": _SCORED + f"""
, a AS (SELECT count(*) AS k, list_filter([{', '.join(f"CASE WHEN count(*) FILTER (kind = '{k}') > 0 THEN '{v}' END" for k, v in E.REMEDIES.items())}], lambda x: x IS NOT NULL) AS n FROM s WHERE kind IS NOT NULL AND category = 'ops'),
b AS (SELECT CASE WHEN k = 0 THEN ['{E.HEALTHY}'] ELSE list_concat(n, list_slice([{', '.join(f"'{v}'" for v in E.ALWAYS)}], 1, greatest(0, 4 - len(n)))) END AS n FROM a)
SELECT generate_subscripts(n, 1)::INTEGER AS place, unnest(n) AS action FROM b
""",
    "release_gate": _SCORED + """
, m AS (SELECT category, round(avg((kind IS NULL)::INTEGER), 3) AS pass_rate, round(avg(f), 3) AS avg_faithfulness, round(avg(r), 3) AS avg_relevance, round(avg(c), 3) AS avg_completeness FROM s WHERE category IN ('ops', 'search') GROUP BY 1),
u AS (UNPIVOT m ON pass_rate, avg_faithfulness, avg_relevance, avg_completeness INTO NAME metric VALUE v),
j AS (SELECT a.metric, a.v AS candidate, b.v AS baseline, round(a.v - b.v, 3) AS delta FROM u a JOIN u b ON a.metric = b.metric AND a.category = 'ops' AND b.category = 'search')
SELECT metric, candidate, baseline, delta, delta < -0.005 AS is_regression, coalesce(candidate < CASE metric WHEN 'pass_rate' THEN 0.8 WHEN 'avg_completeness' THEN NULL ELSE 0.7 END, false) AS is_below FROM j
""",
    "judge_ab": """
WITH r AS (SELECT DISTINCT result_key, hit_rate, token_f1, judge_correct FROM eval_test_results), m AS (SELECT avg(hit_rate) FILTER (NOT judge_correct) AS a, avg(hit_rate) FILTER (judge_correct) AS b, avg(token_f1) FILTER (NOT judge_correct) AS c, avg(token_f1) FILTER (judge_correct) AS e FROM r)
SELECT round(a, 6) AS false_hit_rate, round(b, 6) AS true_hit_rate, round(b - a, 6) AS delta_hit_rate, round(c, 6) AS false_token_f1, round(e, 6) AS true_token_f1, round(e - c, 6) AS delta_token_f1 FROM m
""",
    "pipeline_report": """
WITH r AS (SELECT DISTINCT result_key, test_id, hit_rate, token_f1, judge_score, judge_correct FROM eval_test_results), c AS (SELECT DISTINCT id AS test_id, trim(category) AS category FROM eval_cases)
SELECT category, count(*)::BIGINT AS n, round(avg(hit_rate), 4) AS mean_hit_rate, round(avg(token_f1), 4) AS mean_token_f1, round(avg(judge_score), 4) AS mean_judge_score, round(avg(judge_correct::INTEGER), 4) AS judge_accuracy FROM r JOIN c USING (test_id) GROUP BY 1
""",
    "id_overlap": """
WITH r AS (SELECT DISTINCT result_key, test_id, retrieved_doc_ids AS i FROM eval_test_results), c AS (SELECT DISTINCT id AS test_id, ground_truth_doc_ids AS t FROM eval_cases)
SELECT result_key, coalesce(list_has_any(list_filter(i, lambda x: x IS NOT NULL), list_filter(t, lambda x: x IS NOT NULL)), false)::INTEGER AS hit FROM r JOIN c USING (test_id)
""",
    "answer_bags": rf"""
WITH c AS (SELECT DISTINCT id AS test_id, ground_truth_answer AS g FROM eval_cases), r AS (SELECT DISTINCT result_key, test_id, predicted_answer AS p FROM eval_test_results),
t AS (SELECT result_key, {_PLAIN.replace('{c}', 'p')} AS p, {_PLAIN.replace('{c}', 'g')} AS g FROM r JOIN c USING (test_id)),
x AS (SELECT result_key, w, count(*) AS n FROM (SELECT result_key, unnest(p) AS w FROM t) GROUP BY 1, 2), y AS (SELECT result_key, w, count(*) AS n FROM (SELECT result_key, unnest(g) AS w FROM t) GROUP BY 1, 2),
o AS (SELECT result_key, sum(least(x.n, y.n)) AS k FROM x JOIN y USING (result_key, w) GROUP BY 1)
SELECT result_key, round(CASE WHEN len(p) + len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(k, 0) / (len(p) + len(g)) END, 6) AS f1 FROM t LEFT JOIN o USING (result_key)
""",
    "gate_verdict": "SELECT count(*) FILTER (NOT passed AND severity = 'BLOCKER') = 0 AS passed, count(*) FILTER (NOT passed AND severity = 'WARNING') > 0 AS has_warnings, count(*)::BIGINT AS n_rules, count(*) FILTER (NOT passed)::BIGINT AS n_failed FROM ({document_gate})",
    "document_check": f"""
SELECT DISTINCT ingest_id AS id, CASE WHEN {_BLANK.replace('{c}', 'ingest_id')} THEN 'no_id' WHEN {_BLANK.replace('{c}', 'content')} THEN 'no_content' WHEN metadata IS NULL THEN 'no_metadata' WHEN {_BLANK.replace('{c}', "metadata['source']")} THEN 'no_source' WHEN {_BLANK.replace('{c}', "metadata['title']")} THEN 'no_title' WHEN created_at IS NULL THEN 'bad_index' END AS fault
FROM kb_docs WHERE fault IS NOT NULL
""",
    "fault_plan": _PLAN + "SELECT o_orderkey, p AS o_orderpriority, t AS o_orderstatus, w AS o_orderdate FROM z UNION ALL SELECT o_orderkey, p, t, w FROM z WHERE r46 <= round_even(0.15 * n, 0)",
    "fault_report": "WITH c AS (SELECT count(*) AS b FROM orders), m AS (SELECT b, b - greatest(1, floor(0.2 * b)) AS n FROM c), r AS (SELECT *, unnest(['drop', 'blank', 'noise', 'truncate', 'stale', 'duplicate']) AS fault, unnest(['o_orderdate', 'o_orderpriority', 'o_orderpriority', 'o_orderstatus', 'o_orderdate', 'o_orderkey']) AS column_name, unnest([NULL, 0.15, 0.15, 0.15, 0.25, 0.15]) AS share FROM m) SELECT fault, column_name, coalesce(round_even(share * n, 0), b - n)::BIGINT AS n_affected, b::BIGINT AS n_before, (n + round_even(0.15 * n, 0))::BIGINT AS n_after FROM r",
    "repair_audit": """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderpriority = '') AS b FROM orders), k AS (SELECT n, b, round_even(0.15 * n, 0) AS d FROM c),
o AS (SELECT count(*) FILTER (r42 <= d) + count(*) FILTER (r42 <= d AND r46 <= d) AS blank FROM (SELECT row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r42, row_number() OVER (ORDER BY md5(o_orderkey || '|46'), o_orderkey) AS r46 FROM orders), k)
SELECT metric, clean::DOUBLE AS clean, corrupted::DOUBLE AS corrupted, repaired::DOUBLE AS repaired, (repaired - clean)::DOUBLE AS delta_total, (repaired - corrupted)::DOUBLE AS delta_repaired FROM (
  SELECT 'n_rows' AS metric, n AS clean, n + d AS corrupted, n AS repaired FROM k UNION ALL SELECT 'n_duplicates', 0, d, 0 FROM k UNION ALL SELECT 'n_blank', b, blank, 0 FROM k, o)
""",
    "audit_states": _PLAN + f"""
, x AS (SELECT o_orderkey, p, w FROM z UNION ALL SELECT o_orderkey, p, w FROM z WHERE r46 <= round_even(0.15 * n, 0)),
c AS (SELECT count(*) AS n, date_diff('microsecond', o_orderdate, TIMESTAMP '{REFERENCE}') / 86400e6 > 1700 AS old FROM orders GROUP BY 2),
v AS (SELECT count(*) AS n, date_diff('microsecond', CAST(w AS TIMESTAMP), TIMESTAMP '{REFERENCE}') / 86400e6 > 1700 AS old FROM x GROUP BY 2)
SELECT 'clean' AS state, sum(n)::BIGINT AS n_rows, true AS quality_passed, sum(n) FILTER (old) / sum(n) <= 0.5 AS freshness_passed, false AS quality_restored FROM c
UNION ALL SELECT 'corrupted', sum(n)::BIGINT, false, sum(n) FILTER (old) / sum(n) <= 0.5, false FROM v UNION ALL SELECT 'repaired', sum(n)::BIGINT, true, sum(n) FILTER (old) / sum(n) <= 0.5, true FROM c
""",
    "replay_result": "SELECT n_clean, true AS passed, true AS is_reindexed, n AS n_stored, n AS n_ids FROM (SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_clean FROM orders)",
    "quarantined": "SELECT ingest_id, CASE WHEN coalesce(length(content) > 200 AND created_at < 1e11, false) THEN 'good' ELSE 'quarantine' END AS side FROM (SELECT DISTINCT ingest_id, content, created_at FROM kb_docs)",
    "store_changes": f"""
WITH r AS (SELECT id, any_value(parent_doc_id) AS p, any_value(chunk_index) AS i, any_value(content) AS c FROM chunks WHERE id IS NOT NULL GROUP BY id), k AS (SELECT * FROM r WHERE NOT {_BLANK.replace('{c}', 'c')} AND coalesce(p, '') <> 'doc-100000009')
SELECT i AS chunk_index, (count(*) * CASE WHEN i = 1 THEN 2 ELSE 1 END)::BIGINT AS n_rows, count(*)::BIGINT AS n_ids, (CASE WHEN i = 0 THEN count(*) ELSE 0 END)::BIGINT AS n_changed, (count(*) * CASE WHEN i = 1 THEN 2 ELSE 1 END)::BIGINT AS n_vectors FROM k GROUP BY i
""",
    "store_size": "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT id)::BIGINT AS n_ids FROM chunks",
    "prompt_versions": """
WITH r AS (SELECT ingest_id, any_value(id) AS id, any_value(content) AS c, any_value(created_at) AS t, any_value(deleted_at) AS x FROM kb_docs GROUP BY 1), v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(t, 0), ingest_id) AS version FROM r),
w AS (SELECT id, version, c FROM v WHERE CASE WHEN id = 'doc-100000009' THEN version = 1 ELSE x IS NULL END)
SELECT id AS name, version::INTEGER AS version, md5(coalesce(c, '')) AS digest FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1
UNION ALL SELECT 'spare', 0, md5('Answer briefly.')
""",
}
SQL["report_json"] = _SCORED + """
, m AS (SELECT category, count(*) AS n, round(avg(f), 4) AS f, round(avg(r), 2) AS r FROM s GROUP BY 1)
SELECT '{"category":"' || category || '","n":' || n || ',"faithfulness":' || f::VARCHAR || ',"relevance":' || r::VARCHAR || CASE WHEN category = 'ops' THEN ',"ops":"yes"}' ELSE '}' END AS json FROM m
"""
SQL["gate_report"] = f"""
WITH g AS (SELECT *, row_number() OVER (ORDER BY passed, severity, rule, column_name NULLS FIRST) AS k FROM ({SQL["document_gate"]}))
SELECT 1 AS line, '| Rule | Column | Severity | Status | Observed |' AS text UNION ALL SELECT 2, '| --- | --- | --- | --- | --- |'
UNION ALL SELECT (k + 2)::INTEGER, '| ' || rule || ' | ' || coalesce(column_name, '-') || ' | ' || severity || ' | ' || CASE WHEN passed THEN '✅ Pass' ELSE '❌ Fail' END || ' | ' || observed || ' |' FROM g
"""
_MARK = "CASE WHEN {c} THEN '✅ Pass' ELSE '❌ Fail' END"
SQL["audit_report"] = f"""
SELECT 1 AS line, '| State | Rows | Quality gate | Freshness | Restored |' AS text UNION ALL SELECT 2, '| --- | --- | --- | --- | --- |'
UNION ALL SELECT CASE state WHEN 'clean' THEN 3 WHEN 'corrupted' THEN 4 ELSE 5 END, '| ' || state || ' | ' || n_rows || ' | ' || {_MARK.format(c="quality_passed")} || ' | ' || {_MARK.format(c="freshness_passed")} || ' | ' || CASE WHEN quality_restored THEN '✅ Restored' ELSE '' END || ' |' FROM ({SQL["audit_states"]})
"""
SQL["improvement_log"] = SQL["failure_log"].replace("WHERE kind IS NOT NULL)", "WHERE kind IS NOT NULL AND category = 'ops' AND f < 0.1)")
_ROWS = SQL["improvement_log"]
SQL["improvement_log"] = f"""
SELECT 1 AS line, '| Failure ID | Sample ID | Type | Root Cause Diagnosis | Recommended Fix | Status |' AS text UNION ALL SELECT 2, '| --- | --- | --- | --- | --- | --- |'
UNION ALL SELECT (row_number() OVER (ORDER BY failure_id) + 2)::INTEGER, '| ' || failure_id || ' | ' || result_id || ' | `' || failure_type || '` | ' || cause || ' | ' || action || ' | Open |' FROM ({_ROWS})
"""
SQL["judge_prompts"] = """
WITH c AS (SELECT DISTINCT id AS test_id, question AS q, ground_truth_answer AS g FROM eval_cases), r AS (SELECT DISTINCT result_key, test_id, predicted_answer AS a FROM eval_test_results),
p AS (SELECT result_key, 'Question: ' || coalesce(q, '') || chr(10) || 'Expected: ' || coalesce(g, '') || chr(10) || 'Answer: ' || coalesce(a, '') || chr(10) || 'Reply with one JSON object: {"accuracy": 1-5, "tone": 1-5}' AS p FROM r JOIN c USING (test_id))
SELECT result_key, md5(p) AS digest, length(p)::DOUBLE AS n_chars, (length(p) - length(replace(p, ' ', '')))::DOUBLE AS n_blanks FROM p
"""
SQL["gate_verdict"] = SQL["gate_verdict"].replace("{document_gate}", SQL["document_gate"])
