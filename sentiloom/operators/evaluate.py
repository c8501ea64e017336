"""Scores of predictions, from one small table of outcome counts.

``df`` has ``gold``, ``pred`` and ``implicit``.  The data is read once and
shrinks on the map side to its distinct outcomes; all measures follow from
those counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom import constants as K
from sentiloom.operators.scale import dense_index
from sentiloom.operators.shape import eval_slices

CODES = tuple(range(len(K.LABELS)))


def outcomes(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(
        *(by or []), F.col("implicit").cast("int").alias("implicit"), "gold", "pred"
    ).agg(F.count("*").alias("n"))


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _f1(code: int, among: Column) -> Column:
    gold, pred = F.col("gold") == code, F.col("pred") == code
    hits = _n(among & gold & pred)
    either = _n(among & gold) + _n(among & pred)
    return F.when(either > 0, 2 * hits / either).otherwise(F.lit(0.0))


def _macro(among: Column) -> Column:
    """Mean over all label codes; an absent label counts as 0."""
    return sum((_f1(c, among) for c in CODES), F.lit(0.0)) / len(CODES)


def _percent(c: Column) -> Column:
    return F.round(c * 100, 3)



def accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    same = _n(F.col("gold") == F.col("pred"))
    return outcomes(df, by).groupBy(*(by or [])).agg(
        _percent(same / F.sum("n")).alias("accuracy")
    )


def macro_f1(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return outcomes(df, by).groupBy(*(by or [])).agg(
        _percent(_macro(F.lit(True))).alias("macro_f1")
    )


def macro_f1_by_slice(df: DataFrame) -> DataFrame:
    """Macro-F1 of the slices 'total', 'explicits', 'implicits'."""
    return eval_slices(outcomes(df)).groupBy("slice").agg(
        _percent(_macro(F.lit(True))).alias("macro_f1")
    )


def report_score(df: DataFrame, mode: str = "test", by: list[str] | None = None) -> DataFrame:
    """Score record: accuracy and macro-F1, all, explicit and implicit rows."""
    same = _n(F.col("gold") == F.col("pred"))
    return (
        outcomes(df, by)
        .groupBy(*(by or []))
        .agg(
            _percent(same / F.sum("n")).alias("Acc_SA"),
            _percent(_macro(F.lit(True))).alias("F1_SA"),
            _percent(_macro(F.col("implicit") == 0)).alias("F1_ESA"),
            _percent(_macro(F.col("implicit") == 1)).alias("F1_ISA"),
        )
        .withColumn("default", F.col("F1_SA"))
        .withColumn("mode", F.lit(mode))
    )


def metric_history(records: list[DataFrame] | DataFrame, order: str = "mode") -> DataFrame:
    """Score records as one table with their number ``idx``.

    A list is numbered as it comes, a table of records in the order of a column.
    """
    columns = ["idx", "mode", "Acc_SA", "F1_SA", "F1_ESA", "F1_ISA", "default"]
    if isinstance(records, DataFrame):
        return dense_index(records, [order], "idx").select(*columns)
    if not records:
        raise ValueError("no records")
    rows = [r.withColumn("idx", F.lit(i).cast("bigint")).select(*columns) for i, r in enumerate(records)]
    return reduce(DataFrame.unionByName, rows)


def best_run(history: DataFrame, score: str = "default", order: str = "idx") -> DataFrame:
    """The record with the highest score, the first one on ties."""
    return history.orderBy(F.col(score).desc_nulls_last(), F.col(order).asc()).limit(1)
