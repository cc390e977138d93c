"""Cutting documents into chunks: one row per chunk, with its index and the number of chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def fixed(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of size characters that overlap; the last one reaches the end. One chunk if the text is no longer than size."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")) * step
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))


def by_sentences(text: Column, per_chunk: int = 3) -> Column:
    """Groups of sentences (split after . ! ? and at line ends), joined by blanks."""
    split = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), strip), lambda x: x != "")

    def grouped(s: Column) -> Column:
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(per_chunk))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(s, i, F.lit(per_chunk)), " "))

    # inside an array the sentences are split once, not once for every group
    return F.transform(F.array(split), grouped)[0]


def windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Stripped windows of size characters every size - overlap characters (at least 1); a blank one is null, so that the others keep their places."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.nullif(strip(F.substring(text, i + 1, F.lit(size))), F.lit("")))


def spans(text: str, a: int, b: int, size: int, separators: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Places of the chunks of text[a:b].

    A separator's occurrences give the starts of the parts, and a part's cost (its
    length and the separator's) is the distance to the next start. So the longest run
    of parts that fits ends at the last start within size of its first one, which a
    binary search over the starts finds. A part that is itself too long is cut by the
    separators after this one, at last into slices.
    """
    if b - a <= size:
        yield a, b
        return
    here = next((k for k, s in enumerate(separators) if s == "" or text.find(s, a, b) >= 0), len(separators))
    if not "".join(separators[here : here + 1]):
        yield from ((at, min(at + size, b)) for at in range(a, b, size))
        return
    sep = separators[here]
    starts = [a, *(m.end() for m in re.compile(re.escape(sep)).finditer(text, a, b)), b + len(sep)]
    first = 0
    while first < len(starts) - 1:
        stop = max(first + 1, bisect_right(starts, starts[first] + size) - 1)
        end = starts[stop] - len(sep)
        yield from spans(text, starts[first], end, size, separators[here + 1 :]) if end - starts[first] > size else [(starts[first], end)]
        first = stop


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text: runs of the parts between the first separator present, as long as they fit; stripped, without blank ones. A text that fits, or that has no separator, stays unstripped."""
    found = list(spans(text, 0, len(text), size, separators)) if text else []
    if not any(s and s in text for s in separators) or len(text) <= size:
        return [text[a:b] for a, b in found]
    return [x for a, b in found if (x := text[a:b].strip())]


def recursive(text: Column, size: int = 500, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Recursive packing as of pieces(), in Arrow batches: how a part is cut depends on what came before, which no expression says."""

    @F.pandas_udf("array<string>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pieces(t, size, separators))

    return apply(text)


def by_strategy(text: Column, strategy: str, size: int = 500, overlap: int = 50, per_chunk: int = 3) -> Column:
    """The chunk expression of a named strategy: 'fixed_size', 'by_sentences', 'windows'; any other name means recursive."""
    made = {"fixed_size": lambda: fixed(text, size, overlap), "by_sentences": lambda: by_sentences(text, per_chunk), "windows": lambda: windows(text, size, overlap)}
    return made.get(strategy, lambda: recursive(text, size))()


def chunk_documents(docs: DataFrame, chunks: Column, id_col: str = "id", text: str = "content", form: str = "_chunk_") -> DataFrame:
    """One row per chunk: id (document id, form, index), parent_doc_id, content, chunk_index, n_chunks; other columns of docs follow where names don't clash.

    Documents whose text is null or blank give no chunks, and null chunks are left out
    without renumbering the others. The chunk expression sees the column ``_text``,
    the text without blanks around it.
    """
    names = ("id", "parent_doc_id", "content", "chunk_index", "n_chunks")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text, *names)]
    cut = docs.withColumn("_text", strip(F.col(text))).where(F.col("_text") != "").withColumn("_chunks", chunks)
    return cut.select(F.col(id_col).cast("string").alias("parent_doc_id"), F.size(F.array_compact("_chunks")).alias("n_chunks"), F.posexplode("_chunks").alias("chunk_index", "content"), *others).where(F.col("content").isNotNull()).select(
        F.concat("parent_doc_id", F.lit(form), "chunk_index").alias("id"), "parent_doc_id", "content", "chunk_index", "n_chunks", *others
    )


def compare_strategies(docs: DataFrame, id_col: str, text: str, size: int = 500) -> DataFrame:
    """Per document and strategy: n_chunks, avg_length (2 digits), min_length, max_length."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    named = {"fixed_size": fixed(F.col("t"), size, min(50, size // 5)), "by_sentences": by_sentences(F.col("t")), "recursive": recursive(F.col("t"), size)}
    rows = base.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("chunks")) for k, v in named.items()])).alias("x")).select("id", "x.*")
    lengths = F.transform("chunks", lambda c: F.length(c))
    total = F.aggregate(lengths, F.lit(0), lambda a, b: a + b)
    n = F.size("chunks")
    return rows.select(
        "id", "strategy", n.alias("n_chunks"), F.when(n > 0, F.round(total / F.when(n > 0, n), 2)).otherwise(0.0).alias("avg_length"),
        F.coalesce(F.array_min(lengths), F.lit(0)).alias("min_length"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("max_length"),
    )
