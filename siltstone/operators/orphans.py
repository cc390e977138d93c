"""References to records that do not exist, are deleted or arrived later.

Parent keys are split into a prefix and a trailing integer; sorted integers are
compressed into contiguous runs, and every distinct reference is matched as-of
the preceding run start: a reference beyond that run's end leads nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs never cross a multiple of this, so the as-of match of one (prefix, bucket) sees at most so many parent keys, however many share a prefix.
BUCKET = 1 << 20
#: Copies of each problem key in the last join; the rows of one hot reference spread over as many tasks.
SALTS = 16


def canonical_id(c: Column) -> Column:
    """Trimmed (any Unicode blank, zero-width marks too) and in lower case; blank becomes null."""
    s = F.lower(F.regexp_replace(c, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", ""))
    return F.when(s != "", s)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds prefix, number and bucket. The digit count belongs to the prefix, as 'doc-07' is not 'doc-7'; keys without digits get number 0."""
    digits = F.regexp_extract(key, r"([0-9]{1,15})$", 1)
    return (
        df.withColumn("_digits", digits)
        .withColumn("_prefix", F.concat(F.expr(f"left({key}, length({key}) - length(_digits))"), F.lit("#"), F.length("_digits")))
        .withColumn("_number", F.coalesce(F.expr("try_cast(_digits AS BIGINT)"), F.lit(0).cast("bigint")))
        .withColumn("_bucket", F.floor(F.col("_number") / BUCKET))
        .drop("_digits")
    )


def key_runs(keys: DataFrame, key: str) -> DataFrame:
    """Contiguous runs (prefix, bucket, run_start, run_end) of the distinct non-null keys."""
    w = Window.partitionBy("_prefix", "_bucket").orderBy("_number")
    numbered = _numbered(keys.select(key).where(F.col(key).isNotNull()).distinct(), key)
    return (
        numbered.withColumn("_island", F.col("_number") - F.row_number().over(w))
        .groupBy("_prefix", "_bucket", "_island")
        .agg(F.min("_number").alias("run_start"), F.max("_number").alias("run_end"))
        .drop("_island")
    )


def parent_states(parents: DataFrame, id_col: str = "id", created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """One row per parent key: first_seen (earliest epoch seconds, null if unknown) and is_deleted (of the newest version).

    Epochs in milliseconds (beyond the year 5000 as seconds) are turned into seconds. Versions without a time count as oldest; of equally new
    versions the deleted one wins.
    """
    at = F.when(F.col(created) > 1e11, F.col(created) / 1000).otherwise(F.col(created))
    rows = parents.select(canonical_id(F.col(id_col)).alias("key"), F.when(~F.isnan(at), at).alias("_at"), F.col(deleted).isNotNull().alias("_gone"))
    return (
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("_at").alias("first_seen"), F.max(F.struct(F.coalesce("_at", F.lit(float("-inf"))).alias("t"), "_gone"))["_gone"].alias("is_deleted"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame, id_col: str = "id", created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """Every reference to a parent that is missing, deleted or first seen after the reference.

    refs has src_table, record_id, ref_id (raw) and at (timestamp); other columns
    are ignored. Null and blank references are none. Result, distinct: src_table,
    record_id, ref_id (canonical), reason ('missing', else 'deleted', else
    'late'), ref_month. A null ``at`` is never late and has a null month. An empty
    parents table makes every reference missing; empty refs give no rows.

    Plan: references are reduced to distinct keys (map-side combined) before
    anything else moves; runs and keys meet by (prefix, bucket), which bounds the
    rows of one window; only keys that can fail join the rows, salted.
    """
    rows = refs.select("src_table", "record_id", canonical_id(F.col("ref_id")).alias("ref_id"), "at").where(F.col("ref_id").isNotNull())
    seconds = F.unix_micros(F.col("at").cast("timestamp")) / 1e6
    keys = rows.groupBy(F.col("ref_id").alias("key")).agg(F.min(seconds).alias("first_ref"))
    states = parent_states(parents, id_col, created, deleted)

    runs = key_runs(states, "key").select("_prefix", "_bucket", F.col("run_start").alias("_number"), "run_end", F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("first_ref"))
    asked = _numbered(keys, "key").select("_prefix", "_bucket", "_number", F.lit(None).cast("bigint").alias("run_end"), "key", "first_ref")
    w = Window.partitionBy("_prefix", "_bucket").orderBy("_number", F.col("key").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        runs.unionByName(asked)
        .withColumn("_end", F.last("run_end", ignorenulls=True).over(w))
        .where(F.col("key").isNotNull())
        .select("key", "first_ref", F.coalesce(F.col("_end") < F.col("_number"), F.lit(True)).alias("is_missing"))
    )
    # only parents that are deleted or dated can make a reference fail that is inside a run
    able = states.where(F.col("is_deleted") | F.col("first_seen").isNotNull())
    failing = (
        matched.join(able, "key", "left")
        .where(F.col("is_missing") | F.col("is_deleted") | (F.col("first_seen") > F.col("first_ref")))
        .select(F.col("key").alias("ref_id"), "is_missing", "is_deleted", "first_seen", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    reason = F.when(F.col("is_missing"), "missing").when(F.col("is_deleted"), "deleted").when(F.col("first_seen") > seconds, "late")
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
        .join(failing, ["ref_id", "_salt"])
        .select("src_table", "record_id", "ref_id", reason.alias("reason"), F.date_format("at", "yyyy-MM").alias("ref_month"))
        .where(F.col("reason").isNotNull())
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphans.groupBy("src_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_id").alias("n_ids"))
