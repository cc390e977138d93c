"""Queries of the training-data problems, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import defects, languages, leaks, mixing, neighbours, percentiles, pii
from siltstone.session import stored, table

GROUPS = ["deployment", "event"]
#: Labelled documents that the language model of problem 2 is fitted on, at most.
LANGUAGE_SAMPLE = 10_000
#: Key of the surrogates in the registered query; users pass their own secret.
SURROGATE_KEY = "example key"


# Problem 1

MIN_SIMILARITY = 0.85


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "chunks"), "id", "embedding", neighbours.Settings(k=5, min_similarity=MIN_SIMILARITY))
    return neighbours.similar_pairs(near, MIN_SIMILARITY)


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings")
    return neighbours.nearest(vectors, "vec_id", "embedding", neighbours.Settings(k=10), vectors.where(F.col("vec_id") % 50 == 0))


# Problem 2


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "eval_results").select(F.lit("eval_results").alias("src_table"), F.col("result_id").alias("record_id"), "question", F.col("generated_answer").alias("answer"))
    cases = table(spark, d, "eval_cases").select(F.lit("eval_cases").alias("src_table"), F.col("id").alias("record_id"), "question", F.col("ground_truth_answer").alias("answer"))
    return results.unionByName(cases)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    model = languages.fit(table(spark, d, "documents"), sample=LANGUAGE_SAMPLE)
    return defects.defective_pairs(_pairs(spark, d), model).select("src_table", "record_id", "defect")


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs per table and type."""
    return p2_found(spark, d).groupBy("src_table", "defect").agg(F.count(F.lit(1)).alias("n_pairs"))


# Problem 3


def _texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, name).select(F.lit(name).alias("src_table"), F.col(key).alias("record_id"), F.col(text).alias("text"))
        for name, key, text in (("kb_docs", "ingest_id", "content"), ("generation_results", "generation_id", "answer"), ("eval_test_results", "result_key", "predicted_answer"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _pseudonymised(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of personal information with its surrogate."""
    return pii.pseudonymised(stored(pii.personal_information(_texts(spark, d)), "pii"), SURROGATE_KEY)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The places that surrogates replace."""
    return _pseudonymised(spark, d).select("src_table", "record_id", "pii_type", "start_pos", "end_pos").distinct()


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """All texts with typed placeholders in place of personal information."""
    texts = _texts(spark, d).distinct()
    return pii.replaced(texts, pii.personal_information(texts))


def p3_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """All texts with keyed, type-consistent surrogates in place of personal information."""
    return pii.replaced(_texts(spark, d).distinct(), _pseudonymised(spark, d))


# Problem 4


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = percentiles.once(table(spark, d, "triage_results"), *GROUPS, "latency_ms")
    return percentiles.groups_above(rows, GROUPS, "latency_ms", 0.95, 3000.0, least=0.0)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = percentiles.once(table(spark, d, "triage_results"), *GROUPS, "latency_ms")
    return percentiles.percentiles(percentiles.sketches(rows, GROUPS, "latency_ms", least=0.0))


def p4_event_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per event, merged from the sketches of event and day."""
    rows = percentiles.once(table(spark, d, "triage_results"), "event", "ts", "latency_ms").withColumn("day", F.to_date(F.expr("try_cast(ts AS timestamp)")))
    days = percentiles.sketches(rows, ["event", "day"], "latency_ms", least=0.0)
    return percentiles.percentiles(percentiles.merged(days, ["event"]))


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per event, merged from those of days, held against the true ranks: within three times the 99 % error everywhere."""
    rows = stored(percentiles.once(table(spark, d, "triage_results"), "event", "ts", "latency_ms").withColumn("day", F.to_date(F.expr("try_cast(ts AS timestamp)"))), "latencies")  # read twice
    qs = (0.5, 0.95, 0.99)
    days = percentiles.sketches(rows, ["event", "day"], "latency_ms", least=0.0)
    estimates = stored(percentiles.percentiles(percentiles.merged(days, ["event"]), qs), "estimates")
    return percentiles.held_bounds(rows, estimates, ["event"], "latency_ms", qs, 3 * percentiles.rank_error(), 0.0)


# Problem 6


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id").distinct()


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans to remove from each document, and the items they give away."""
    return leaks.removal_spans(leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_items")))


# Problem 7


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's size; the texts are tokenized once, as several steps need the sizes."""
    return stored(mixing.sized(table(spark, d, "documents")), "sizes")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short(_sizes(spark, d), table(spark, d, "mix_targets")).select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(_sizes(spark, d), targets), targets)


# Problem 8


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.label_issues(languages.languages(table(spark, d, "documents")))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.languages(table(spark, d, "documents")).select("doc_id", "language", "confidence", "label")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_search, p2_found, p2_defects, p3_found, p3_masked, p3_surrogates, p4_found, p4_percentiles, p4_event_days, p4_bounds, p6_found, p6_spans, p7_found, p7_shares, p8_found, p8_languages, p8_segments)}

SQL = {
    "p1_found": """
WITH v AS (
  SELECT id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM chunks
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND NOT isnan(list_sum(embedding)) GROUP BY id
), s AS (
  SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id
), r AS (
  SELECT id, other, c, row_number() OVER (PARTITION BY id ORDER BY round(c, 6) DESC, other) AS rn FROM s WHERE c >= 0.85
)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE rn <= 5
""",
    "p4_found": """
SELECT deployment, event FROM (SELECT DISTINCT * FROM triage_results) WHERE latency_ms >= 0 AND NOT isnan(latency_ms)
GROUP BY deployment, event HAVING quantile_cont(latency_ms, 0.95) > 3000
""",
    "p4_bounds": """
SELECT event, count(*)::BIGINT AS n, true AS p50_holds, true AS p95_holds, true AS p99_holds FROM (SELECT DISTINCT * FROM triage_results) WHERE latency_ms >= 0 AND NOT isnan(latency_ms) GROUP BY event
""",
}
