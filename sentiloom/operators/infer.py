"""The one hook for a model: a function from a prompt batch to an answer batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom.operators.scale import stored

#: What this worker has built, by model; a worker process serves many tasks.
_BUILT: dict[str, Callable[[list[str]], list[str]]] = {}
ANSWERS = "id string, answer string, model string"


def infer(
    prompts: DataFrame,
    fn: Callable[[list[str]], list[str]],
    key: str,
    prompt: str = "prompt",
    answer: str = "answer",
) -> DataFrame:
    """``(key, answer)`` for every prompt.

    ``fn`` gets the prompts of one Arrow batch and returns as many answers.
    Write the result to a table before use: a plan that is run again would
    call the model again.
    """
    schema = T.StructType(
        [prompts.schema[key], T.StructField(answer, T.StringType())]
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = fn(part[prompt].tolist())
            if len(answers) != len(part):
                raise ValueError(f"{len(part)} prompts but {len(answers)} answers")
            yield pd.DataFrame({key: part[key], answer: answers})

    return prompts.select(key, prompt).mapInPandas(run, schema)


def prompt_id(model: str, prompt: str) -> F.Column:
    """The address of an answer: a hash of the model's name and the prompt."""
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), F.col(prompt)), 256)


def stored_answers(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``(id, answer)`` of one model, each id once, however many runs wrote it."""
    try:
        rows = spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], ANSWERS)
    return rows.where(F.col("model") == model).groupBy("id").agg(F.min("answer").alias("answer"))


def infer_stored(
    prompts: DataFrame,
    build: Callable[[], Callable[[list[str]], list[str]]],
    key: str,
    path: str,
    model: str,
    prompt: str = "prompt",
    answer: str = "answer",
    parts: int = 1,
) -> DataFrame:
    """``(key, answer)`` for every prompt, asking only what no run has asked before.

    Answers live at ``path`` by the hash of model and prompt.  Equal prompts are
    asked once, prompts with an answer not at all, and the result is read from
    the table, so no plan calls the model again.  ``build`` makes the function
    once in each Python worker.  The open prompts are asked in ``parts`` jobs,
    each of which keeps its answers: a run that dies loses one part, and a task
    that is tried again replaces what it wrote.  A null prompt has a null
    answer, and an answer that is null is not asked for again.
    """
    spark = prompts.sparkSession
    asked = prompts.select(key, prompt).withColumn("id", prompt_id(model, prompt))
    distinct = asked.where("id IS NOT NULL").groupBy("id").agg(F.first(prompt).alias("prompt"))
    missing = stored(distinct.join(stored_answers(spark, path, model), "id", "left_anti"), "open-prompts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            if model not in _BUILT:
                _BUILT[model] = build()
            answers = _BUILT[model](batch["prompt"].tolist())
            if len(answers) != len(batch):
                raise ValueError(f"{len(batch)} prompts but {len(answers)} answers")
            yield pd.DataFrame({"id": batch["id"], "answer": answers})

    for part in range(parts):
        mine = missing.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        answers = mine.mapInPandas(run, "id string, answer string").withColumn("model", F.lit(model))
        answers.write.mode("append").partitionBy("model").parquet(path)
    return asked.join(stored_answers(spark, path, model), "id", "left").select(key, F.col("answer").alias(answer))
