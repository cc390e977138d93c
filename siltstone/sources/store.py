"""A chunk store as a parquet table: append, upsert, delete, size. Changes are written beside and swapped in by the caller's catalog or path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import is_blank
from siltstone.functions.vectors import mock_embedding


def records(chunks: DataFrame, embed=mock_embedding, id_col: str = "id", content: str = "content", metadata: str = "metadata", embedding: str = "embedding") -> DataFrame:
    """Rows ready for the store: blank content left out, doc_id put into the metadata where missing, embedding computed where null. embed: Column -> Column."""
    doc = F.create_map(F.lit("doc_id"), F.coalesce(F.col("parent_doc_id") if "parent_doc_id" in chunks.columns else F.lit(None).cast("string"), F.col(id_col).cast("string")))
    known = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
    filled = F.when(F.map_contains_key(known, "doc_id"), known).otherwise(F.map_from_entries(F.concat(F.map_entries(known), F.map_entries(doc))))
    vector = F.coalesce(F.col(embedding).cast("array<double>"), embed(F.col(content))) if embedding in chunks.columns else embed(F.col(content))
    return chunks.where(~is_blank(F.col(content))).withColumn(metadata, filled).withColumn(embedding, vector)


def append(store: DataFrame, rows: DataFrame, content: str = "content") -> DataFrame:
    """The store with the rows whose content isn't blank added as they are; ids may repeat."""
    return store.unionByName(rows.where(~is_blank(F.col(content))).select(*store.columns))


def size(store: DataFrame) -> DataFrame:
    """One row: n_rows, n_ids."""
    return store.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


def upsert(store: DataFrame, changes: DataFrame, id_col: str = "id", version: str | None = None) -> DataFrame:
    """The store with the changed rows in place of those of the same id. Idempotent.

    Of repeated changes the one of the highest version stays; equal versions, or no
    version column, are told apart by all columns but maps, so the choice is the same
    every time.
    """
    order = [F.col(f"`{c}`") for c in ([version] if version else []) + sorted(c for c, t in changes.dtypes if c not in (id_col, version) and not t.startswith("map"))]
    row = F.struct(*[F.col(f"`{c}`") for c in changes.columns])
    fresh = changes.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")
    return store.join(fresh.select(id_col), id_col, "left_anti").select(*store.columns).unionByName(fresh.select(*store.columns))


def delete_document(store: DataFrame, doc_id: str) -> DataFrame:
    """The store without the rows whose id, parent or metadata (doc_id, parent_id) is doc_id."""
    hit = F.col("id").eqNullSafe(F.lit(doc_id))
    if "parent_doc_id" in store.columns:
        hit = hit | F.col("parent_doc_id").eqNullSafe(F.lit(doc_id))
    if "metadata" in store.columns:
        for key in ("doc_id", "parent_id"):
            hit = hit | F.try_element_at("metadata", F.lit(key)).eqNullSafe(F.lit(doc_id))
    return store.where(~hit)
