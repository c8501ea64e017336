"""Corpus counts kept up batch by batch.

A store is a folder of three tables, written by Spark alone:

``deltas``       ``(v, w, n, df)`` by ``batch``: what one batch of texts adds
``generations``  the same, merged, by ``generation``
``merged``       which batches a generation holds

A row with a NULL ``w`` counts the word ``v``: ``n`` times in ``df`` texts.  One
with both counts a pair of words in a row, ``n`` times.  One with neither counts
the batch's texts, also those without a word.

A batch is counted from its own texts and replaces what an earlier attempt under
its name wrote, so a replay adds nothing.  The counts of the corpus are the last
generation and all batches that it does not hold.  A generation counts from the
moment its list of batches is there; a compaction that dies before is made
anew.  A batch that is merged stays as it is: adding it again does nothing.
Any number of batches may be written at a time, one compaction among them.
Deltas that a generation holds are no longer read, and their folders may go.

A NULL or empty text counts as a text without words, a text that stands there
twice counts twice, an empty batch counts as no text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiloom.functions import text as X
from sentiloom.operators.scale import dense_index

COUNTS = "v string, w string, n bigint, df bigint"


def batch_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(v, w, n, df)`` of these texts alone, read once for words and pairs together."""
    none = F.lit(None).cast("string")
    part = lambda v, w, n, df: F.struct(
        v.alias("v"), w.alias("w"), F.lit(n).cast("bigint").alias("n"), F.lit(df).cast("bigint").alias("df")
    )

    def parts(ws: F.Column) -> F.Column:
        """All words, the different ones and the pairs of a text; nothing is sorted or counted inside it."""
        alone = F.slice(ws, 1, 0)
        n = F.greatest(F.array_size(ws) - 1, F.lit(0))
        pairs = part(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), 1, 0)
        return F.array(part(ws, alone, 1, 0), part(F.array_distinct(ws), alone, 0, 1), pairs)

    counted = (
        docs.select(F.inline(X.let(X.words(text), parts)))
        .select(F.inline(F.arrays_zip("v", "w")), "n", "df")
        .groupBy("v", "w")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    )
    texts = docs.agg(F.count("*").alias("n")).select(none.alias("v"), none.alias("w"), "n", F.lit(0).cast("bigint").alias("df"))
    return counted.unionByName(texts)


def _table(spark: SparkSession, path: str, columns: str) -> DataFrame:
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def _write(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _state(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last generation, 0 for none, and its batches (a name for each, no rows of theirs)."""
    merged = _table(spark, f"{path}/merged", "batch string, generation int")
    last = merged.agg(F.max("generation")).first()[0] or 0
    return last, [r["batch"] for r in merged.where(F.col("generation") == last).select("batch").collect()]


def add_batch(docs: DataFrame, path: str, batch: str, text: str = "text") -> bool:
    """Count a batch; False if a generation holds it already."""
    if not batch:
        raise ValueError("a batch needs a name")
    if batch in _state(docs.sparkSession, path)[1]:
        return False
    _write(batch_counts(docs, text).withColumn("batch", F.lit(batch)), f"{path}/deltas", "batch")
    return True


def _open(spark: SparkSession, path: str, held: list[str]) -> DataFrame:
    deltas = _table(spark, f"{path}/deltas", f"{COUNTS}, batch string")
    return deltas.where(~F.col("batch").isin(held)) if held else deltas


def counts(spark: SparkSession, path: str) -> DataFrame:
    """``(v, w, n, df)`` over all batches."""
    last, held = _state(spark, path)
    base = _table(spark, f"{path}/generations", f"{COUNTS}, generation int").where(F.col("generation") == last)
    every = base.drop("generation").unionByName(_open(spark, path, held).drop("batch"))
    return every.groupBy("v", "w").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def compact(spark: SparkSession, path: str) -> int:
    """Merge the last generation and the open batches into the next one; its number."""
    last, held = _state(spark, path)
    names = _open(spark, path, held).where("v IS NULL").select("batch").distinct()  # every batch has such a row
    fresh = [r["batch"] for r in names.collect()]
    if not fresh:
        return last
    base = _table(spark, f"{path}/generations", f"{COUNTS}, generation int").where(F.col("generation") == last)
    deltas = _open(spark, path, held).where(F.col("batch").isin(fresh))
    every = base.drop("generation").unionByName(deltas.drop("batch"))
    summed = every.groupBy("v", "w").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    _write(summed.withColumn("generation", F.lit(last + 1)), f"{path}/generations", "generation")
    listed = spark.createDataFrame([(b,) for b in held + fresh], "batch string")
    _write(listed.coalesce(1).withColumn("generation", F.lit(last + 1)), f"{path}/merged", "generation")
    return last + 1


def kept_words(spark: SparkSession, path: str) -> DataFrame:
    """``(word, n, df)``; the metrics take it as ``words``."""
    return counts(spark, path).where("v IS NOT NULL AND w IS NULL").select(F.col("v").alias("word"), "n", "df")


def kept_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(v, w, n)``; the metrics take it as ``pairs``."""
    return counts(spark, path).where("v IS NOT NULL AND w IS NOT NULL").select("v", "w", "n")


def kept_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(n)``: how many texts were counted, in one row."""
    return counts(spark, path).where("v IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def kept_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary ``(word, n, df, id)`` with dense ids in word order."""
    return dense_index(kept_words(spark, path), ["word"], "id")
