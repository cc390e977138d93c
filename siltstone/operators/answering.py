"""From documents to answers: ingest into a store, contexts and prompts from ranked chunks, answers by a plugged-in model, checks of what comes out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import is_blank, strip
from siltstone.operators.chunking import chunk_documents
from siltstone.operators.retrieval import context_blocks, ends_first
from siltstone.sources.store import records, upsert

#: What stands for a context without chunks, and for an answer without a context.
NOTHING = "No relevant context found."
REFUSAL = "Tôi không thể xác minh thông tin này từ các tài liệu được cung cấp."
FAILURE = "Lỗi trong quá trình tạo câu trả lời: "
#: The two prompts.
TEMPLATE = (
    "You are an expert AI assistant answering questions based strictly on provided knowledge chunks.\n"
    "Guidelines:\n"
    "1. Only use facts contained within the [CONTEXT] blocks below.\n"
    "2. If the context does not contain enough information to answer truthfully, state: 'I do not have enough information in the provided context to answer this question.'\n"
    "3. Cite source references whenever referencing facts (e.g. [Source: doc_id]).\n\n"
    "[CONTEXT]\n{context}\n\n[QUESTION]\n{question}\n\n[ANSWER]"
)
GROUNDED_TEMPLATE = "TÀI LIỆU THAM KHẢO:\n{context}\n\nCÂU HỎI:\n{question}\n\nHãy trả lời câu hỏi kèm citation chi tiết."
#: Retrieval methods, and those that an answer may name as its source.
METHODS = ("dense", "bm25", "hybrid", "pageindex", "reranked")
SOURCES = ("hybrid", "dense", "bm25", "pageindex", "none")


def ingest(docs: DataFrame, chunks: Column, store: DataFrame, embed: Callable[[Column], Column], id_col: str = "id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(the store with the documents' chunks, embedded, in place of chunks of the same id; n_chunks per parent_doc_id).

    chunks is a chunk expression over ``_text``. Documents without text give no chunks.
    """
    cut = chunk_documents(docs, chunks, id_col, text)
    ready = records(cut if "metadata" in cut.columns else cut.withColumn("metadata", F.lit(None).cast("map<string,string>")), embed)
    return upsert(store, ready.select(*store.columns)), cut.groupBy("parent_doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def with_vectors(chunks: DataFrame, vectors: DataFrame, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Chunks with their vectors by id, never by position; a chunk without one has null."""
    own = vectors.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(vector, F.to_json(F.struct(vector))).alias("_vector"))
    return chunks.drop(vector).join(own, F.col(id_col) == F.col("_id"), "left").withColumnRenamed("_vector", vector).drop("_id")


def verify_index(store: DataFrame, chunks: DataFrame, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """One row: n_expected (distinct ids of chunks), n_stored, n_missing, n_without_vector, is_complete."""
    want = chunks.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    have = store.groupBy(id_col).agg(F.max(F.coalesce(F.size(vector), F.lit(0))).alias("_n"))
    joined = want.join(have, id_col, "left")
    out = joined.agg(F.count(F.lit(1)).alias("n_expected"), F.count("_n").alias("n_stored"), F.count_if(F.col("_n").isNull()).alias("n_missing"), F.count_if(F.col("_n") < 1).alias("n_without_vector"))
    return out.withColumn("is_complete", (F.col("n_missing") == 0) & (F.col("n_without_vector") == 0))


def numbered_contexts(ranked: DataFrame) -> DataFrame:
    """query_id, context, n_chunks: '--- Document Chunk n [Source: s] (relevance: 0.123) ---' and the stripped content, by rank.

    The source is metadata.source, else parent_doc_id, else id; a null score is left out.
    """
    known = F.try_element_at("metadata", F.lit("source")) if "metadata" in ranked.columns else F.lit(None).cast("string")
    parent = F.col("parent_doc_id") if "parent_doc_id" in ranked.columns else F.lit(None).cast("string")
    source = F.coalesce(F.nullif(known, F.lit("")), F.nullif(parent, F.lit("")), F.col("id").cast("string"))
    score = F.coalesce(F.concat(F.lit(" (relevance: "), F.format_string("%.3f", F.when(F.col("score").isNotNull(), F.col("score")).otherwise(0.0)), F.lit(")")), F.lit(""))
    header = F.concat(F.lit("--- Document Chunk "), F.col("rank").cast("string"), F.lit(" [Source: "), source, F.lit("]"), F.when(F.col("score").isNull(), "").otherwise(score), F.lit(" ---"))
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return context_blocks(ranked.withColumn("content", strip(F.coalesce("content", F.lit("")))), header).join(n, "query_id")


def cited_contexts(ranked: DataFrame, order: str = "place") -> DataFrame:
    """query_id, context: '[Tài liệu n | Tiêu đề: title | Nguồn: source (Chunk i)]' and the content, joined by rules."""
    m = lambda k, default: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(default)) if "metadata" in ranked.columns else F.lit(default)
    header = F.concat(F.lit("[Tài liệu "), F.col(order).cast("string"), F.lit(" | Tiêu đề: "), m("title", "Untitled"), F.lit(" | Nguồn: "), m("source", "Unknown"), F.lit(" (Chunk "), m("chunk_index", "0"), F.lit(")]"))
    return context_blocks(ranked, header, order, "\n\n---\n\n", trimmed=False)


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced; braces inside the values stay as they are."""
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*[values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def answered(questions: DataFrame, ranked: DataFrame, model: Callable[[Column], Column], template: str = TEMPLATE, min_score: float = 0.0) -> DataFrame:
    """query_id, question, n_chunks, prompt, answer, error for every question: retrieval cut at min_score, context, prompt, model.

    questions has query_id and query_text; ranked has query_id, id, content, score, rank
    and optionally metadata and parent_doc_id. Without chunks the context says so.
    model is a column function giving struct(answer, error), see functions.models.
    """
    kept = ranked.where(F.col("score") >= min_score)
    asked = questions.select("query_id", strip(F.coalesce("query_text", F.lit(""))).alias("question")).join(numbered_contexts(kept), "query_id", "left")
    prompts = asked.withColumn("prompt", _filled(template, {"context": F.coalesce("context", F.lit(NOTHING)), "question": F.col("question")}))
    return prompts.withColumn("_a", model(F.col("prompt"))).select("query_id", "question", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "prompt", F.col("_a.answer").alias("answer"), F.col("_a.error").alias("error"))


def grounded(questions: DataFrame, ranked: DataFrame, model: Callable[[Column], Column], template: str = GROUNDED_TEMPLATE) -> DataFrame:
    """query_id, answer, sources (ids and scores by rank), retrieval_source for every question.

    Chunks are put best first and last, cited and sent to the model. Without chunks the
    answer is REFUSAL and the source 'none'; a failing model gives FAILURE and its
    message. The source is the first chunk's method; methods that are no source count
    as 'hybrid'.
    """
    placed = ends_first(ranked)
    prompts = questions.select("query_id", F.coalesce("query_text", F.lit("")).alias("question")).join(cited_contexts(placed), "query_id", "left").withColumn("prompt", _filled(template, {"context": F.coalesce("context", F.lit("")), "question": F.col("question")}))
    source = F.struct(F.col("rank").alias("r"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    method = F.min_by("method", "rank") if "method" in ranked.columns else F.lit("hybrid")
    lists = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(source)), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("sources"), method.alias("_method"))  # k rows a query
    out = prompts.join(lists, "query_id", "left").withColumn("_a", model(F.col("prompt")))
    some = F.col("context").isNotNull()
    return out.select(
        "query_id",
        F.when(~some, REFUSAL).when(F.col("_a.error").isNotNull(), F.concat(F.lit(FAILURE), F.col("_a.error"))).otherwise(F.col("_a.answer")).alias("answer"),
        F.coalesce("sources", F.array().cast("array<struct<id:string,score:double>>")).alias("sources"),
        F.when(~some, "none").when(F.col("_method").isin(*SOURCES[:4]), F.col("_method")).otherwise("hybrid").alias("retrieval_source"),
    )


def generation_fault(answer: Column, sources: Column, retrieval_source: Column) -> Column:
    """The first fault of a generated answer: 'no_answer', 'duplicate_source', 'bad_score', 'not_sorted', 'bad_retrieval_source'; null if it is sound. sources: array<struct<id, score>>."""
    s = F.coalesce(sources, F.array().cast("array<struct<id:string,score:double>>"))
    ids, scores = F.transform(s, lambda x: x["id"]), F.transform(s, lambda x: x["score"])
    return (
        F.when(is_blank(answer), "no_answer")
        .when(F.exists(scores, lambda x: x.isNull() | F.isnan(x)), "bad_score")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_source")
        .when(scores != F.reverse(F.array_sort(scores)), "not_sorted")
        .when(~F.coalesce(retrieval_source.isin(*SOURCES), F.lit(False)), "bad_retrieval_source")
    )


def is_confirmed(confirmed: Column, required: Column, current: Column | None = None) -> Column:
    """A change may go ahead: it was confirmed, and what was confirmed is still what is asked for (an empty or missing current summary doesn't object)."""
    same = F.lit(True) if current is None else (F.coalesce(current, F.lit("")) == "") | required.eqNullSafe(current)
    return F.coalesce(confirmed, F.lit(False)) & same
