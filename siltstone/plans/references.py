"""Queries of the reference check (problem 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.orphans import orphan_counts, orphan_references
from siltstone.session import table


def _refs(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("src_table"), F.col("id").alias("record_id"), F.col("parent_doc_id").alias("ref_id"), F.col("ingested_at").alias("at"))
    cases = table(spark, d, "eval_cases").select(F.lit("eval_cases").alias("src_table"), F.col("id").alias("record_id"), F.explode("ground_truth_doc_ids").alias("ref_id"), F.col("added_at").alias("at"))
    return chunks.unionByName(cases)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_refs(spark, d), table(spark, d, "kb_docs"))


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p5_found(spark, d))


QUERIES = {"p5_found": p5_found, "p5_by_month": p5_by_month}

_FOUND = """
WITH refs AS (
  SELECT 'chunks' AS src_table, id AS record_id, lower(trim(parent_doc_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(65279))) AS ref_id, ingested_at AS at_ FROM chunks
  UNION ALL
  SELECT 'eval_cases', id, lower(trim(r, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(65279))), added_at FROM (SELECT id, added_at, unnest(ground_truth_doc_ids) AS r FROM eval_cases)
), kb AS (
  SELECT lower(trim(id, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(65279))) AS k, CASE WHEN created_at > 1e11 THEN created_at / 1000 ELSE created_at END AS c, deleted_at FROM kb_docs
), states AS (
  SELECT k, min(c) AS first_seen, max(struct_pack(t := coalesce(c, -1e300), g := deleted_at IS NOT NULL)).g AS gone FROM kb GROUP BY k
), tagged AS (
  SELECT src_table, record_id, ref_id, at_,
         CASE WHEN s.k IS NULL THEN 'missing' WHEN s.gone THEN 'deleted' WHEN s.first_seen > epoch_us(at_) / 1e6 THEN 'late' END AS reason
  FROM refs LEFT JOIN states s ON s.k = ref_id WHERE ref_id IS NOT NULL AND ref_id <> ''
)
SELECT DISTINCT src_table, record_id, ref_id, reason, strftime(at_ AT TIME ZONE 'UTC', '%Y-%m') AS ref_month FROM tagged WHERE reason IS NOT NULL
"""

SQL = {
    "p5_found": _FOUND,
    "p5_by_month": f"SELECT src_table, ref_month, reason, CAST(count(*) AS BIGINT) AS n_refs, CAST(count(DISTINCT ref_id) AS BIGINT) AS n_ids FROM ({_FOUND}) GROUP BY 1, 2, 3",
}
