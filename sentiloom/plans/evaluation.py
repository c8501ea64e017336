"""The evaluation job: predictions, from a table or a trace, to score records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.functions import responses as R
from sentiloom.operators import evaluate as E


def evaluate(
    predictions: DataFrame,
    answer: str = "answer",
    mode: str = "test",
    decoder: str = "exact",
    by: list[str] | None = None,
) -> DataFrame:
    """Decode answers, then score them; needs gold, implicit and the answer."""
    decode = {"exact": R.decode_exact, "contains": R.decode_contains}[decoder]
    return E.report_score(predictions.withColumn("pred", decode(answer)), mode, by)


def evaluate_trace(trace: DataFrame, mode: str = "test") -> DataFrame:
    """Score the readable records of a reasoning trace."""
    rows = trace.where(F.col("reject_reason").isNull()).select(
        R.label_code("gold").alias("gold"), R.label_code("predicted").alias("pred"), "implicit"
    )
    return E.report_score(rows, mode)
