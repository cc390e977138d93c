"""Search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import models
from siltstone.functions import vectors as V
from siltstone.functions.text import STOPWORDS
from siltstone.operators import answering as A
from siltstone.operators import chunking as C
from siltstone.operators import evaluation as E
from siltstone.operators import retrieval as R
from siltstone.session import table


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(every vector; the queries: those whose id is divisible by 50)."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return rows, rows.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, queries = _vectors(spark, d)
    return _rounded(R.dense_topk(queries, rows, 5))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Only vectors whose metadata say label 1, and only scores of at least 0.2."""
    rows, queries = _vectors(spark, d)
    rows = rows.withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string"))).where(R.matches(F.col("metadata"), {"label": "1", "absent": None}))
    return _rounded(R.dense_topk(queries, rows, 5, min_score=0.2))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: the questions whose number is divisible by 50."""
    number = F.expr("try_cast(regexp_extract(id, '([0-9]+)$', 1) AS bigint)")
    return table(spark, d, "eval_cases").where(number % 50 == 0).select(F.col("id").alias("query_id"), F.col("question").alias("query_text")).distinct()


def _kb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_docs").select(F.col("ingest_id").alias("id"), "content").distinct()


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.bm25_topk(_questions(spark, d), _kb(spark, d), 5))


def _dense(spark: SparkSession, d: str) -> R.Search:
    """The questions' best documents of the knowledge base by vectors."""
    embedded = _kb(spark, d).withColumn("embedding", V.mock_embedding(F.coalesce("content", F.lit(""))))
    return lambda questions, k: R.dense_topk(questions.withColumn("embedding", V.mock_embedding(F.col("query_text"))), embedded, k)


def _lexical(spark: SparkSession, d: str) -> R.Search:
    """The same by keywords; a document without any keyword scores 0 and still has a place."""
    return lambda questions, k: R.bm25_topk(questions, _kb(spark, d), k)


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose best vector scores below 0.36 fall back to keywords."""
    return R.hybrid_search(_questions(spark, d), _dense(spark, d), _lexical(spark, d), 0, 0.36, _lexical(spark, d))


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    questions = _questions(spark, d)
    return R.reciprocal_rank_fusion([_dense(spark, d)(questions, 10), _lexical(spark, d)(questions, 10)], 5).withColumn("score", F.round("score", 9))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).withColumn("score", F.round("score", 6))


def _with_content(ranked: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    kb = table(spark, d, "kb_docs").select(F.col("ingest_id").alias("id"), "content", F.create_map(F.lit("title"), F.coalesce(F.try_element_at("metadata", F.lit("title")), F.lit("Untitled")), F.lit("source"), F.coalesce(F.try_element_at("metadata", F.lit("source")), F.lit("Unknown"))).alias("metadata"))
    return ranked.join(kb.dropDuplicates(["id"]), "id")


def hybrid_rag(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: keyword and dense search over the knowledge base fused, with a fallback, reordered, cited and answered."""
    ranked = _with_content(_hybrid(spark, d), spark, d)
    out = A.grounded(_questions(spark, d), ranked, models.answerer(models.mock_model))
    return out.select("query_id", "answer", F.array_join(F.transform("sources", lambda x: x["id"]), ",").alias("sources"), "retrieval_source")


def dense_rag(spark: SparkSession, d: str) -> DataFrame:
    """Dense search with a minimum score, numbered contexts, prompt and model; questions without a good chunk say so."""
    ranked = _with_content(_dense(spark, d)(_questions(spark, d), 3), spark, d)
    out = A.answered(_questions(spark, d), ranked, models.answerer(models.mock_model), min_score=0.42)
    return out.select("query_id", "n_chunks", F.length("prompt").alias("n_prompt"), F.md5("prompt").alias("digest"), "answer", "error")


def retrieval_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Mean hit and reciprocal rank over all test results."""
    return E.benchmark_report(retrieval_scores(spark, d))


def ranking_check(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the stored source lists: as if each list stood in rank order and held at most two sources."""
    rows = table(spark, d, "generation_results").select("generation_id", "sources", "retrieval_source").distinct()
    ranked = rows.select(F.col("generation_id").alias("query_id"), F.posexplode("sources").alias("p", "s"), F.col("retrieval_source").alias("method")).select("query_id", "s.id", "s.score", (F.col("p") + 1).alias("rank"), "method")
    return R.ranking_faults(ranked, 2, ("hybrid", "dense")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def generation_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generation_results").select("generation_id", "answer", "sources", "retrieval_source").distinct()
    return rows.select("generation_id", F.coalesce(A.generation_fault(F.col("answer"), F.col("sources"), F.col("retrieval_source")), F.lit("sound")).alias("fault"))


def overlap_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of every evaluation result, reordered by the question's words that they hold."""
    rows = table(spark, d, "eval_results").select("result_id", "question", "retrieved_contexts").distinct()
    ranked = rows.select(F.col("result_id").alias("query_id"), F.col("question").alias("query_text"), F.posexplode("retrieved_contexts").alias("p", "content")).withColumn("rank", F.col("p") + 1)
    return R.overlap_rerank(ranked).select("query_id", F.col("p").alias("place"), "overlap", "rank")


def catalogue_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first documents, by id, of a category whose title or text holds a word."""
    rows = table(spark, d, "kb_docs").select(F.col("ingest_id").alias("id"), "content", F.try_element_at("metadata", F.lit("title")).alias("title"), F.try_element_at("metadata", F.lit("doc_type")).alias("category")).distinct()
    return R.lookup(rows, " ALERT ", "guide", 50).select("id", "category")


def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the next one by id: cosine, and both forms of a score from a distance."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pair = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    c = V.cosine(F.col("v"), F.col("w"))
    return pair.select("vec_id", F.round(c, 6).alias("cosine"), F.round(V.inverse_distance(1 - c), 6).alias("inverse"), F.round(V.complement(1 - c), 6).alias("complement"), F.round(V.dot(F.col("v"), F.col("w")), 5).alias("dot"))


def ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base cut, embedded and put into an empty store: chunks, characters and vectors per document, and what is missing."""
    docs = table(spark, d, "kb_docs").select(F.col("ingest_id").alias("id"), "content").dropDuplicates(["id"])
    empty = spark.createDataFrame([], "id string, parent_doc_id string, content string, chunk_index int, metadata map<string,string>, embedding array<double>")
    store, counts = A.ingest(docs, C.fixed(F.col("_text"), 200, 40), empty, V.mock_embedding)
    have = store.groupBy("parent_doc_id").agg(F.count(F.lit(1)).alias("n_stored"), F.sum(F.length("content")).alias("n_chars"), F.sum(F.size("embedding")).cast("bigint").alias("n_numbers"), F.count_if(F.col("metadata.doc_id") == F.col("parent_doc_id")).alias("n_named"))
    return counts.join(have, "parent_doc_id")


def index_check(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against the vectors attached to them by id."""
    chunks = table(spark, d, "chunks").select("id", "content", F.col("embedding").alias("v")).distinct()
    attached = A.with_vectors(chunks.select("id", "content"), chunks.where(F.col("v").isNotNull()).select("id", F.col("v").alias("embedding")))
    return A.verify_index(attached, chunks)


def reordered(spark: SparkSession, d: str) -> DataFrame:
    rows, queries = _vectors(spark, d)
    return R.ends_first(R.dense_topk(queries, rows, 7)).select("query_id", "id", "rank", "place")


def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hit and reciprocal rank of the ids that a test retrieved, per test result."""
    results = table(spark, d, "eval_test_results").select("result_key", "test_id", "retrieved_doc_ids").distinct()
    ranked = results.select(F.col("result_key").alias("query_id"), F.posexplode("retrieved_doc_ids").alias("pos", "id")).withColumn("rank", F.col("pos") + 1)
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("test_id"), F.col("ground_truth_doc_ids").alias("expected_doc_ids")).distinct()
    expected = results.join(cases, "test_id").select(F.col("result_key").alias("query_id"), "expected_doc_ids")
    return R.reciprocal_ranks(ranked, expected).withColumn("rr", F.round("rr", 6))


def mock_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = V.mock_embedding(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").withColumn("v", v).select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.round(V.norm(F.col("v")), 6).alias("length"))


QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_filtered, rank_fusion, hybrid_search, bm25_topk, hybrid_rag, dense_rag, reordered, retrieval_scores, retrieval_benchmark, ranking_check, generation_check, overlap_ranks, catalogue_lookup, vector_scores, ingested_chunks, index_check, mock_vectors)}

_RANKED = """
  SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity({q}, {e}) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity({q}, {e}), 9) DESC, e.vec_id) AS rank
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0) q,
       (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings) e {where}"""
_WHOLE = _RANKED.format(q="q.v", e="e.v", where="")
_B = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_QUESTIONS = "(SELECT DISTINCT id AS query_id, question AS query_text FROM eval_cases WHERE TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0)"
_SPLIT = rf"list_filter(regexp_split_to_array(lower(coalesce({{c}}, '')), '{_B}+'), lambda w: w <> '')"

#: Ranked lists of k documents a question: lex by keywords, dense by mock vectors.
_LISTS = rf"""
WITH RECURSIVE docs AS (SELECT DISTINCT ingest_id AS id, content FROM kb_docs),
tok AS (SELECT id, {_SPLIT.replace("{c}", "content")} AS t FROM docs),
tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY term, id, dl),
idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, tot GROUP BY term, n),
fl AS (SELECT 0.25 * avg(idf) AS f FROM idf),
q AS (SELECT query_id, term, count(*) AS qf FROM {_QUESTIONS} c, unnest({_SPLIT.replace("{c}", "query_text")}) AS u(term) GROUP BY 1, 2),
sc AS (
  SELECT q.query_id, p.id, sum(qf * CASE WHEN i.idf < 0 THEN f ELSE i.idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN idf i USING (term) JOIN post p USING (term), fl, tot GROUP BY 1, 2
), al AS (
  SELECT query_id, d.id, coalesce(score, 0.0) AS score FROM {_QUESTIONS} CROSS JOIN docs d LEFT JOIN sc USING (query_id, id)
), lex AS (
  SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM al) WHERE rank <= {{k}}
), lcg(n, a, k) AS (
  SELECT 1, 1664525::HUGEINT, 1013904223::HUGEINT
  UNION ALL SELECT n + 1, (a * 1664525) % 4294967296, (k * 1664525 + 1013904223) % 4294967296 FROM lcg WHERE n < 64
), tx AS (SELECT 'd' AS kind, id, coalesce(content, '') AS x FROM docs UNION ALL SELECT 'q', query_id, coalesce(query_text, '') FROM {_QUESTIONS}),
sd AS (SELECT kind, id, CAST('0x' || right(md5(x), 8) AS BIGINT)::HUGEINT AS s FROM tx),
vec AS (SELECT kind, id, list(CAST((a * s + k) % 4294967296 AS DOUBLE) / 4294967295.0 * 2 - 1 ORDER BY n) AS v FROM sd, lcg GROUP BY kind, id),
dense AS (
  SELECT query_id, id, score, rank FROM (
    SELECT a.id AS query_id, b.id, list_cosine_similarity(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.id) AS rank
    FROM vec a, vec b WHERE a.kind = 'q' AND b.kind = 'd') WHERE rank <= {{k}}
)"""
_FUSED = _LISTS.replace("{k}", "10") + """,
u AS (SELECT query_id, id, rank, 0 AS l FROM dense UNION ALL SELECT query_id, id, rank, 1 FROM lex),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS place FROM u GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place, id) AS rk FROM f)"""
_HYBRID = _FUSED + """,
s AS (SELECT query_id FROM dense GROUP BY 1 HAVING max(score) >= 0.36),
hyb AS (
  SELECT query_id, id, score, rk AS rank, 'hybrid' AS method FROM fused WHERE rk <= 5 AND query_id IN (FROM s)
  UNION ALL SELECT query_id, id, score, rank, 'fallback' FROM lex WHERE rank <= 5 AND query_id NOT IN (FROM s)
)"""
_META = "(SELECT DISTINCT ingest_id AS id, content, metadata['title'] AS title, metadata['source'] AS source FROM kb_docs)"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_TOK = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), lambda w: NOT list_contains(" + _STOP + ", w)))"
_TEMPLATE = A.TEMPLATE.replace("'", "''").split("{context}")
_STRIP = f"regexp_replace({{c}}, '^{_B}+|{_B}+$', '', 'g')"

SQL = {
    "dense_topk": f"SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_WHOLE}) WHERE rank <= 5",
    "dense_topk_filtered": f"SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format(q='q.v', e='e.v', where='WHERE label = 1')}) WHERE rank <= 5 AND score >= 0.2",
    "rank_fusion": f"{_FUSED} SELECT query_id, id, round(score, 9) AS score, CAST(place // 1000 AS INTEGER) AS first_list, CAST(rk AS INTEGER) AS rank FROM fused WHERE rk <= 5",
    "hybrid_search": f"{_HYBRID} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, method FROM hyb",
    "bm25_topk": f"{_LISTS.replace("{k}", "5")} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lex",
    "hybrid_rag": f"""{_HYBRID},
n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM hyb),
p AS (SELECT n.*, m.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 2 * n + 1 - rank END) AS pl FROM n JOIN {_META} m ON n.id = m.id),
c AS (SELECT query_id, string_agg('[Tài liệu ' || pl || ' | Tiêu đề: ' || coalesce(title, 'Untitled') || ' | Nguồn: ' || coalesce(source, 'Unknown') || ' (Chunk 0)]' || chr(10) || coalesce(content, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pl) AS c FROM p GROUP BY 1),
g AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS sources, min_by(method, rank) AS method FROM hyb GROUP BY 1)
SELECT query_id, 'MOCK[' || length('TÀI LIỆU THAM KHẢO:' || chr(10) || c || chr(10) || chr(10) || 'CÂU HỎI:' || chr(10) || query_text || chr(10) || chr(10) || 'Hãy trả lời câu hỏi kèm citation chi tiết.') || ']' AS answer, sources, 'hybrid' AS retrieval_source
FROM {_QUESTIONS} JOIN c USING (query_id) JOIN g USING (query_id)
""",
    "dense_rag": f"""{_LISTS.replace("{k}", "3")},
c AS (SELECT query_id, count(*) AS n, string_agg('--- Document Chunk ' || rank || ' [Source: ' || coalesce(nullif(source, ''), 'Unknown') || '] (relevance: ' || printf('%.3f', score) || ') ---' || chr(10) || {_STRIP.replace("{c}", "coalesce(content, '')")}, chr(10) || chr(10) ORDER BY rank) AS c
  FROM dense JOIN {_META} m USING (id) WHERE score >= 0.42 GROUP BY 1),
x AS (SELECT query_id, coalesce(n, 0) AS n, '{_TEMPLATE[0]}' || coalesce(c, 'No relevant context found.') || replace('{_TEMPLATE[1]}', '{{question}}', {_STRIP.replace("{c}", "query_text")}) AS p FROM {_QUESTIONS} LEFT JOIN c USING (query_id))
SELECT query_id, n::BIGINT AS n_chunks, length(p)::INTEGER AS n_prompt, md5(p) AS digest, 'MOCK[' || length(p) || ']' AS answer, NULL::VARCHAR AS error FROM x
""",
    "reordered": f"""
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 100 - rank END) AS INTEGER) AS place
FROM ({_WHOLE}) WHERE rank <= 7
""",
    "retrieval_scores": """
WITH r AS (SELECT DISTINCT result_key, test_id, retrieved_doc_ids AS ids FROM eval_test_results), c AS (SELECT DISTINCT id, ground_truth_doc_ids AS truth FROM eval_cases),
k AS (SELECT result_key, ids, truth FROM r JOIN c ON r.test_id = c.id),
p AS (SELECT result_key, min(pos) AS first FROM (SELECT result_key, truth, unnest(ids) AS d, generate_subscripts(ids, 1) AS pos FROM k) WHERE len(list_filter(truth, lambda e: starts_with(d, e))) > 0 GROUP BY 1)
SELECT k.result_key AS query_id, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr FROM k LEFT JOIN p USING (result_key)
""",
    "mock_vectors": """
WITH RECURSIVE c(n, a, k) AS (
  SELECT 1, 1664525::HUGEINT, 1013904223::HUGEINT
  UNION ALL SELECT n + 1, (a * 1664525) % 4294967296, (k * 1664525 + 1013904223) % 4294967296 FROM c WHERE n < 64
), s AS (SELECT doc_id, CAST('0x' || right(md5(coalesce(text, '')), 8) AS BIGINT)::HUGEINT AS s FROM documents),
v AS (SELECT doc_id, n, CAST((a * s + k) % 4294967296 AS DOUBLE) / 4294967295.0 * 2 - 1 AS x FROM s, c)
SELECT doc_id, round(max(CASE WHEN n = 1 THEN x END) / sqrt(sum(x * x)), 6) AS first, round(max(CASE WHEN n = 64 THEN x END) / sqrt(sum(x * x)), 6) AS last, 1.0::DOUBLE AS length FROM v GROUP BY doc_id
""",
    "retrieval_benchmark": """
WITH r AS (SELECT DISTINCT result_key, test_id, retrieved_doc_ids AS ids FROM eval_test_results), c AS (SELECT DISTINCT id, ground_truth_doc_ids AS truth FROM eval_cases),
k AS (SELECT result_key, ids, truth FROM r JOIN c ON r.test_id = c.id),
p AS (SELECT result_key, min(pos) AS first FROM (SELECT result_key, truth, unnest(ids) AS d, generate_subscripts(ids, 1) AS pos FROM k) WHERE len(list_filter(truth, lambda e: starts_with(d, e))) > 0 GROUP BY 1)
SELECT count(*)::BIGINT AS n_queries, round(avg((first IS NOT NULL)::INTEGER), 4) AS mean_hit, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mean_rr, 0.0::DOUBLE AS mean_latency_ms FROM k LEFT JOIN p USING (result_key)
""",
    "ranking_check": """
WITH g AS (SELECT DISTINCT generation_id AS q, sources, retrieval_source AS m FROM generation_results),
r AS (SELECT q, m, unnest(sources) AS s, generate_subscripts(sources, 1) AS rank FROM g), w AS (SELECT q, m, s.id AS id, s.score AS score, lag(s.score) OVER (PARTITION BY q ORDER BY rank) AS prev FROM r),
f AS (
  SELECT q, 'bad_score' AS fault FROM w WHERE score IS NULL OR isnan(score) UNION SELECT q, 'not_sorted' FROM w WHERE score > prev UNION SELECT q, 'bad_method' FROM w WHERE coalesce(m NOT IN ('hybrid', 'dense'), true)
  UNION SELECT q, 'too_many' FROM w GROUP BY q HAVING count(*) > 2 UNION SELECT q, 'duplicate_id' FROM w GROUP BY q HAVING count(DISTINCT id) < count(*)
) SELECT fault, count(*)::BIGINT AS n FROM f GROUP BY fault
""",
    "generation_check": rf"""
WITH g AS (SELECT DISTINCT generation_id, answer, sources, retrieval_source AS m FROM generation_results), s AS (SELECT *, list_transform(sources, lambda x: x.id) AS ids, list_transform(sources, lambda x: x.score) AS sc FROM g)
SELECT generation_id, CASE WHEN answer IS NULL OR regexp_replace(answer, '^{_B}+|{_B}+$', '', 'g') = '' THEN 'no_answer' WHEN len(list_filter(sc, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'bad_score'
  WHEN len(list_distinct(ids)) < len(ids) THEN 'duplicate_source' WHEN sc <> list_reverse_sort(sc) THEN 'not_sorted' WHEN coalesce(m NOT IN ('hybrid', 'dense', 'bm25', 'pageindex', 'none'), true) THEN 'bad_retrieval_source' ELSE 'sound' END AS fault FROM s
""",
    "overlap_ranks": f"""
WITH r AS (SELECT result_id, question, unnest(retrieved_contexts) AS x, generate_subscripts(retrieved_contexts, 1) AS pos FROM (SELECT DISTINCT result_id, question, retrieved_contexts FROM eval_results)),
o AS (SELECT result_id, pos, len(list_intersect({_TOK.replace('{c}', 'question')}, {_TOK.replace('{c}', 'x')})) AS n FROM r)
SELECT result_id AS query_id, (pos - 1)::INTEGER AS place, n::INTEGER AS overlap, row_number() OVER (PARTITION BY result_id ORDER BY n DESC, pos)::INTEGER AS rank FROM o
""",
    "catalogue_lookup": """
SELECT id, category FROM (SELECT DISTINCT ingest_id AS id, content, metadata['title'] AS title, metadata['doc_type'] AS category FROM kb_docs)
WHERE category = 'guide' AND (contains(lower(coalesce(title, '')), 'alert') OR contains(lower(coalesce(content, '')), 'alert')) ORDER BY id LIMIT 10
""",
    "vector_scores": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS c, list_dot_product(a.v, b.v) AS d FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(c, 6) AS cosine, round(1 / (1 + greatest(0, 1 - c)), 6) AS "inverse", round(greatest(0.0, c), 6) AS complement, round(d, 5) AS dot FROM p
""",
    "ingested_chunks": rf"""
WITH t AS (SELECT DISTINCT ingest_id, regexp_replace(content, '^{_B}+|{_B}+$', '', 'g') AS t FROM kb_docs), n AS (SELECT *, greatest(0, ceil((length(t) - 200) / 160.0))::INTEGER AS last FROM t WHERE t <> ''),
c AS (SELECT ingest_id, substring(t, i * 160 + 1, 200) AS c FROM (SELECT *, unnest(range(last + 1)) AS i FROM n)), b AS (SELECT *, regexp_replace(c, '^{_B}+|{_B}+$', '', 'g') <> '' AS ok FROM c)
SELECT ingest_id AS parent_doc_id, count(*)::BIGINT AS n_chunks, count(*) FILTER (ok)::BIGINT AS n_stored, sum(length(c)) FILTER (ok)::BIGINT AS n_chars, (64 * count(*) FILTER (ok))::BIGINT AS n_numbers, count(*) FILTER (ok)::BIGINT AS n_named FROM b GROUP BY 1
""",
    "index_check": """
WITH c AS (SELECT id, max(coalesce(len(embedding), 0)) AS n FROM chunks WHERE id IS NOT NULL GROUP BY id)
SELECT count(*)::BIGINT AS n_expected, count(*)::BIGINT AS n_stored, 0::BIGINT AS n_missing, count(*) FILTER (n < 1)::BIGINT AS n_without_vector, count(*) FILTER (n < 1) = 0 AS is_complete FROM c
""",
}
