"""Where embedding models, language models and judges plug in: batch functions over Arrow, with mocks for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import first_json


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function from a loader; the model is loaded once per task and sees batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return embed


def answerer(load: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A column function struct(answer, error): a failing call gives its message, not a failed job."""

    @F.pandas_udf("struct<answer string, error string>")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(prompt):
            try:
                return model(prompt), None
            except Exception as e:  # noqa: BLE001 - the error is the row's result
                return None, str(e)

        for prompts in batches:
            yield pd.DataFrame([one(p) for p in prompts], columns=["answer", "error"])

    return answer


def mock_model() -> Callable[[str], str]:
    return lambda prompt: f"MOCK[{len(prompt or '')}]"


def judge_prompt(question: Column, answer: Column, expected: Column, criteria: list[str]) -> Column:
    """A rubric prompt that asks for a JSON object of scores from 1 to 5."""
    rubric = ", ".join(f'"{c}": 1-5' for c in criteria)
    return F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nExpected: "), F.coalesce(expected, F.lit("")), F.lit("\nAnswer: "), F.coalesce(answer, F.lit("")), F.lit(f"\nReply with one JSON object: {{{rubric}}}"))


def judge_scores(response: Column, criteria: list[str]) -> Column:
    """Scores of the first JSON object in a reply, scaled to 0..1; missing or unreadable ones count as the middle."""
    from siltstone.functions.metrics import scaled

    found = first_json(response)
    return F.struct(*[scaled(F.get_json_object(found, f"$.{c}").try_cast("double"), 1.0, 5.0).alias(c) for c in criteria])


def resolve_prompts(registry: DataFrame, label: str = "production", fallback: dict[str, str] | None = None) -> DataFrame:
    """The newest version per prompt name that carries the label: name, version, template. Names of fallback without one get its template as version 0."""
    found = registry.where(F.array_contains("labels", label)).groupBy("name").agg(F.max_by(F.struct("version", "template"), "version").alias("x")).select("name", "x.*")
    if not fallback:
        return found
    spare = registry.sparkSession.createDataFrame(list(fallback.items()), "name string, template string").join(found.select("name"), "name", "left_anti")
    return found.unionByName(spare.select("name", F.lit(0).cast(registry.schema["version"].dataType).alias("version"), "template"))


def promote(registry: DataFrame, name: str, version: int, label: str = "production") -> DataFrame:
    """The registry with the label on that version of the prompt and on no other version of it."""
    here, bare = F.col("name") == name, F.array_remove(F.coalesce("labels", F.array().cast("array<string>")), label)
    return registry.withColumn("labels", F.when(here & (F.col("version") == version), F.array_append(bare, F.lit(label))).when(here, bare).otherwise(F.col("labels")))


def rollback(registry: DataFrame, name: str, label: str = "production") -> DataFrame:
    """The label moves to the version before the newest one that carries it; if there is none it stays."""
    own = registry.where(F.col("name") == name)
    now = own.where(F.array_contains("labels", label)).agg(F.max("version").alias("now"))
    before = own.crossJoin(now).where(F.col("version") < F.col("now")).agg(F.max("version").alias("v")).first()["v"]  # one row
    return registry if before is None else promote(registry, name, before, label)
