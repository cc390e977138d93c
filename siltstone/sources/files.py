"""Reading documents from folders and writing them back: text, Markdown, JSON and HTML files; PDF and Word if their readers are installed."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import clean_markdown, is_blank, title_case

SUFFIXES = (".md", ".txt", ".json", ".html", ".htm", ".pdf", ".docx")


def _office(kind: str):
    """Text of PDF or Word files, null where the optional reader is missing or the file can't be read."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        import io

        def one(data):
            try:
                if kind == "pdf":
                    import pypdf

                    return "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
                import docx

                return "\n".join(p.text for p in docx.Document(io.BytesIO(data)).paragraphs)
            except Exception:  # noqa: BLE001 - an unreadable file is a row without text, not a failed job
                return None

        return contents.map(one)

    return read


def scan_documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, path_ids: bool = False) -> DataFrame:
    """id, content, metadata {source, title, doc_type}, path of every readable, non-blank file below folder.

    Hidden files and other suffixes are left out. id is the file name without suffix
    (with path_ids plus a hash of the path, as names may repeat). doc_type is the
    folder's name, or what a JSON file says. JSON text is the first non-empty of
    content_markdown and content, else the whole object. Markdown is cleaned.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    files = raw.select("path", "content", name.alias("name"), suffix.alias("suffix")).where(F.col("suffix").isin(*suffixes) & ~F.col("name").startswith("."))
    text = F.decode("content", "UTF-8")
    object_text = F.coalesce(F.nullif(F.get_json_object(text, "$.content_markdown"), F.lit("")), F.nullif(F.get_json_object(text, "$.content"), F.lit("")), text)
    content = F.when(F.col("suffix") == ".json", object_text).when(F.col("suffix").isin(".md", ".txt"), clean_markdown(text))
    for kind, ends in (("pdf", (".pdf",)), ("docx", (".docx",))):
        if any(e in suffixes for e in ends):
            content = content.when(F.col("suffix").isin(*ends), _office(kind)(F.when(F.col("suffix").isin(*ends), F.col("content"))))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    folder_name = F.element_at(F.split(F.col("path"), "/"), -2)
    doc_type = F.coalesce(F.when(F.col("suffix") == ".json", F.get_json_object(text, "$.doc_type")), F.nullif(folder_name, F.lit("")), F.lit("general"))
    doc_id = F.concat(stem, F.lit("-"), F.substring(F.sha2(F.col("path"), 256), 1, 8)) if path_ids else stem
    return (
        files.select(
            doc_id.alias("id"), content.otherwise(text).alias("content"),
            F.create_map(F.lit("source"), F.col("name"), F.lit("title"), title_case(F.translate(stem, "_-", "  ")), F.lit("doc_type"), doc_type).alias("metadata"), "path",
        ).where(~is_blank(F.col("content")))
    )


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """qa_pairs of a golden-set object, or the rows of a golden-set list, one row each."""
    rows = spark.read.option("multiLine", "true").json(path)
    return rows.select(F.explode("qa_pairs").alias("x")).select("x.*") if "qa_pairs" in rows.columns else rows


def load_corpus(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """path (relative to root), text, fault of a corpus: what manifest.json names, else every .md, .txt and .json file below root.

    The manifest's documents are paths or objects with a path. A path that is
    absolute or leads out of root is 'escapes', one without a file is 'missing'; with
    strict such faults are an error, and at most 20 are named.
    """
    plain = re.sub(r"^\w+:/+", "/", root).rstrip("/")
    relative = F.expr(f"substring(path, instr(path, '{plain}') + {len(plain) + 1})")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative.alias("path"), F.decode("content", "UTF-8").alias("text"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").load(root)
    manifest = found.where(relative == "manifest.json")
    if manifest.limit(1).count() == 0:
        return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(".md", ".txt", ".json")).withColumn("fault", F.lit(None).cast("string"))
    entry = F.explode(F.from_json(F.get_json_object(F.decode("content", "UTF-8"), "$.documents"), "array<string>")).alias("entry")
    named = manifest.select(entry).select(F.coalesce(F.get_json_object("entry", "$.path"), F.col("entry")).alias("named"))
    step = lambda acc, x: F.struct((acc["depth"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("depth"), F.least(acc["least"], acc["depth"] + F.when(x == "..", -1).otherwise(0)).alias("least"))
    walk = F.aggregate(F.split("named", "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), step)
    escapes = F.col("named").startswith("/") | F.col("named").rlike(r"^\w+:") | (walk["least"] < 0)
    tidy = F.array_join(F.filter(F.split("named", "/"), lambda x: ~x.isin("", ".")), "/")
    out = named.select("named", tidy.alias("_path"), escapes.alias("_out")).join(files.withColumnRenamed("path", "_file"), (F.col("_path") == F.col("_file")) & ~F.col("_out"), "left")
    out = out.select(F.col("named").alias("path"), "text", F.when(F.col("_out"), "escapes").when(F.col("_file").isNull(), "missing").alias("fault"))
    if strict:
        bad = out.where(F.col("fault").isNotNull()).select("path", "fault").limit(20).collect()
        if bad:
            raise ValueError("invalid document paths: " + ", ".join(f"{r['path']} ({r['fault']})" for r in bad))
    return out


def write_cache(docs: DataFrame, path: str, by: str = "doc_type") -> None:
    """Cleaned documents as a table in folders by type: the standard form that later runs read instead of the raw files."""
    kept = docs.withColumn("content", clean_markdown(F.col("content"))).where(~is_blank(F.col("content")))
    kept.withColumn(by, F.coalesce(F.try_element_at("metadata", F.lit(by)), F.lit("general"))).write.mode("overwrite").partitionBy(by).parquet(path)


def save_text(lines: DataFrame, path: str) -> None:
    """One small file of the lines of a text column ``value``, such as a manifest; they pass through the driver."""
    spark = lines.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm_path)
    try:
        out.write(bytearray("\n".join(r["value"] for r in lines.select("value").collect()), "utf-8"))
    finally:
        out.close()


def file_manifest(spark: SparkSession, folder: str, names: list[str], length: int = 12) -> DataFrame:
    """name, digest of each named file below folder: the first hex digits of its SHA-256, 'missing' without a file."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.substring(F.sha2("content", 256), 1, length).alias("digest"))
    first = files.groupBy("_name").agg(F.min("digest").alias("digest"))
    return wanted.join(first, F.col("name") == F.col("_name"), "left").select("name", F.coalesce("digest", F.lit("missing")).alias("digest"))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Writes raw rows once (an existing snapshot is an error) and reads them back."""
    df.write.mode("errorifexists").parquet(path)
    return load_snapshot(df.sparkSession, path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The raw rows of a snapshot."""
    return spark.read.parquet(path)


def fetched(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """The snapshot at path, fetched and preserved first if it isn't there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    return load_snapshot(spark, path) if there else snapshot(fetch(), path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """Appends rows as JSON lines or CSV with a header."""
    writer = df.write.mode("append")
    writer.json(path) if form == "json" else writer.option("header", "true").csv(path)


def percent(c: Column) -> Column:
    """A share as text with two digits: 12.34%."""
    return F.when(c.isNotNull(), F.format_string("%.2f%%", F.coalesce(c.cast("double"), F.lit(0.0)) * 100))


def log_experiment(metrics: DataFrame, path: str, shares: tuple[str, ...], columns: tuple[str, ...]) -> None:
    """Appends an iteration to an experiment log (CSV, a header per file): columns as they are, shares as percentages."""
    metrics.select(*columns, *[percent(F.col(c)).alias(c) for c in shares]).coalesce(1).write.mode("append").option("header", "true").csv(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """All iterations of an experiment log."""
    return spark.read.option("header", "true").csv(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small report as a Markdown table; at most ``most`` rows reach the driver, and more are announced."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"more than {most} rows"] if len(rows) > most else []))


def serialized(df: DataFrame, digits: int = 4, own: dict[str, int] | None = None) -> DataFrame:
    """One JSON object per row, column json: numbers with fractions rounded to ``digits`` (or a column's own number of digits), nulls left out."""
    own = own or {}
    shown = [F.round(F.col(f"`{c}`"), own.get(c, digits)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*shown)).alias("json"))


def status(c: Column) -> Column:
    return F.when(c, "✅ Pass").otherwise("❌ Fail")


def gate_markdown(results: DataFrame) -> str:
    """A quality gate's rules, failed ones first."""
    rows = results.orderBy("passed", "severity", "rule", F.col("column_name").asc_nulls_first())
    return markdown_table(rows.select(F.col("rule").alias("Rule"), F.coalesce("column_name", F.lit("-")).alias("Column"), F.col("severity").alias("Severity"), status(F.col("passed")).alias("Status"), F.col("observed").alias("Observed")))


def freshness_markdown(fresh: DataFrame) -> str:
    """Freshness figures; an unknown median is 'N/A'."""
    shown = [F.col("n").alias("Rows"), F.col("n_stale").alias("Stale"), percent(F.col("stale_ratio")).alias("Stale share"), F.when(F.col("median_age_days").isNull(), "N/A").otherwise(F.format_string("%.1f", F.coalesce("median_age_days", F.lit(0.0)))).alias("Median age (days)"), status(F.col("is_fresh")).alias("Status")]
    keys = [F.col(c) for c in fresh.columns if c not in ("n", "n_valid", "n_stale", "stale_ratio", "is_fresh", "min_age_days", "max_age_days", "median_age_days")]
    return markdown_table(fresh.select(*keys, *shown))


def evaluation_markdown(summary: DataFrame, targets: dict[str, float]) -> str:
    """Means of an evaluation against their targets."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("Metric"), F.round(F.col(k).cast("double"), 4).alias("Value"), F.lit(v).alias("Target"), status(F.coalesce(F.col(k) >= v, F.lit(False))).alias("Status")) for k, v in targets.items()]))
    return markdown_table(summary.select(rows.alias("x")).select("x.*"))


def audit_markdown(states: DataFrame) -> str:
    """The states of an audit (clean, corrupted, repaired) side by side."""
    return markdown_table(states.select(F.col("state").alias("State"), F.col("n_rows").alias("Rows"), status(F.col("quality_passed")).alias("Quality gate"), status(F.col("freshness_passed")).alias("Freshness"), F.when(F.col("quality_restored"), "✅ Restored").otherwise("").alias("Restored")))


def improvement_markdown(failures: DataFrame, id_col: str) -> str:
    """Numbered failures with their cause and what to do: failure_id, the sample's id, failure_type, root_cause and action."""
    shown = failures.orderBy("failure_id").select(F.col("failure_id").alias("Failure ID"), F.col(id_col).alias("Sample ID"), F.concat(F.lit("`"), F.coalesce("failure_type", F.lit("Failed")), F.lit("`")).alias("Type"), F.col("root_cause").alias("Root Cause Diagnosis"), F.col("action").alias("Recommended Fix"), F.lit("Open").alias("Status"))
    return markdown_table(shown)
