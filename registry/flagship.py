"""Flagship: the whole sentiment path from raw text to score records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import common as C
from sentiloom.functions import responses as R
from sentiloom.operators import evaluate as E
from sentiloom.operators import lexicon as L


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Text → marked tokens → compound score → label → record per language."""
    docs = C.docs(spark, sf, "doc_id", "text", "lang")
    marked = L.mark_modifiers(docs).withColumnRenamed("marked", "text")
    score = L.compound(marked, C.lexicon(spark))
    answer = F.when(F.col("compound") > 0, "positive").when(F.col("compound") < 0, "negative")
    rows = (
        score.join(docs.select("doc_id", "lang"), "doc_id")
        .join(C.table(spark, sf, "labels"), "doc_id")
        .select(
            "lang",
            F.when(F.col("quality") == 1, 0).otherwise(1).alias("gold"),
            F.col("toxic").alias("implicit"),
            R.decode_contains(answer.otherwise("neutral")).alias("pred"),
        )
    )
    return E.report_score(rows, by=["lang"])
