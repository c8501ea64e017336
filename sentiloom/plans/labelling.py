"""The labelling job: unlabelled comments to label rows, as one plan.

Answers of the model are tables.  Everything a batch asks for carries
``(batch_id, pos)``, so nothing is aligned by luck: a batch whose answer does
not fit is set aside with its reason and labels nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom import constants as K
from sentiloom.functions import prompts as P
from sentiloom.functions import responses as R
from sentiloom.functions.arrays import aspect_mask
from sentiloom.operators import shape
from sentiloom.operators.scale import lookup_join
from sentiloom.schemas import LABELLED


def prompt_batch_aspects(batched: DataFrame, text: str = "text", role: str = K.ASPECT_ROLE) -> DataFrame:
    """One aspect request per batch; a batch has as many rows as it was cut to."""
    listed = F.array_sort(F.collect_list(F.struct("pos", text))).getField(text)
    return (
        batched.groupBy("batch_id")
        .agg(F.to_json(listed).alias("_s"), F.count("*").alias("expected_n"))
        .select(
            "batch_id",
            "expected_n",
            F.lit(role).alias("role"),
            P.batch_aspects(F.col("_s")).alias("prompt"),
        )
    )


def prompt_batch_labels(pairs: DataFrame, text: str = "text", role: str = K.LABEL_ROLE) -> DataFrame:
    """One label request per batch of (sentence, aspect) rows."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "aspect_pos", "aspect", text)))
    texts = F.array_sort(F.collect_set(F.struct("pos", text)))
    return (
        pairs.groupBy("batch_id")
        .agg(rows.alias("_p"), texts.alias("_t"))
        .select(
            "batch_id",
            F.array_size("_p").alias("expected_n"),
            F.lit(role).alias("role"),
            P.batch_labels(
                F.to_json(F.col("_t").getField(text)),
                F.to_json(F.col("_p.aspect")),
                F.array_size("_p"),
            ).alias("prompt"),
        )
    )


def label_reject(response: Column | str) -> Column:
    """The first label that is no polarity 0, 1, 2 or no boolean; NULL when all are."""
    labels = R.parse(response, R.LABEL_ENTRY)
    known = F.sequence(F.lit(0), F.lit(len(K.LABELS) - 1))
    no_code = F.exists(labels, lambda e: ~F.coalesce(F.array_contains(known, e["polarity"]), F.lit(False)))
    no_flag = F.exists(labels, lambda e: R.parse_bool(e["implicitness"]).isNull())
    return F.when(no_code, "unknown polarity").when(no_flag, "not a boolean")


def check_response(expected: DataFrame, responses: DataFrame, labels: bool = False) -> DataFrame:
    """Does each batch have an answer of the right length, made of objects?

    ``expected`` has ``(batch_id, expected_n)``, ``responses`` ``(batch_id, response)``.
    ``labels`` checks the values of label entries as well: one wrong value
    refuses the batch.
    """
    read = responses.select(
        "batch_id",
        F.array_size(R.items("response")).alias("actual_n"),
        R.reject_reason("response").alias("_why"),
        (label_reject("response") if labels else F.lit(None).cast("string")).alias("_value"),
        F.lit(True).alias("_given"),
    )
    return expected.join(read, "batch_id", "left").select(
        "batch_id",
        F.col("expected_n").cast("bigint").alias("expected_n"),
        F.col("actual_n").cast("bigint").alias("actual_n"),
        F.when(F.col("_given").isNull(), "no answer")
        .when(F.col("_why").isNotNull(), F.col("_why"))
        .when(F.col("actual_n") != F.col("expected_n"), "wrong length")
        .otherwise(F.col("_value"))
        .alias("reject_reason"),
    ).withColumn("ok", F.col("reject_reason").isNull())


def _answered(rows: DataFrame, responses: DataFrame, entry: str, labels: bool = False) -> DataFrame:
    """Rows of the batches whose answer passes, each with the batch's ``_entries``.

    Rows are counted where they meet the answer of their batch, so they are
    read once and need no table of expected lengths.
    """
    read = responses.select(
        "batch_id",
        R.parse("response", entry).alias("_entries"),
        R.reject_reason("response").alias("_why"),
        (label_reject("response") if labels else F.lit(None).cast("string")).alias("_value"),
    )
    counted = rows.withColumn("_expected", F.count("*").over(Window.partitionBy("batch_id")))
    fits = F.col("_why").isNull() & F.col("_value").isNull() & (F.array_size("_entries") == F.col("_expected"))
    return counted.join(read, "batch_id").where(fits).drop("_expected", "_why", "_value")


def aspect_rows(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows of accepted batches, one per aspect, numbered within the batch."""
    own = F.get("_entries", F.col("pos").cast("int"))
    listed = _answered(batched, responses, R.ASPECT_ENTRY).withColumn("aspects", R.as_list(own["aspectTerm"]))
    rows = shape.explode_aspects(listed.drop("_entries"), "aspects")
    # a batch is bounded by its size, so numbering inside it is too
    inside = Window.partitionBy("batch_id").orderBy("pos", "aspect_pos")
    return rows.withColumn("pair_no", F.row_number().over(inside) - 1)


def label_rows(pairs: DataFrame, responses: DataFrame) -> DataFrame:
    """Polarity and implicitness for each pair of an accepted batch."""
    own = F.get("_entries", F.col("pair_no").cast("int"))
    found = _answered(pairs, responses, R.LABEL_ENTRY, True)
    return found.select(
        *pairs.columns, R.parse_bool(own["implicitness"]).alias("implicitness"), own["polarity"].alias("polarity")
    )


def rejected_batches(
    batched: DataFrame, aspect_answers: DataFrame, label_answers: DataFrame
) -> DataFrame:
    """Batches that label nothing: which step refused the answer, and why."""
    expected = batched.groupBy("batch_id").agg(F.count("*").alias("expected_n"))
    aspects = check_response(expected, aspect_answers).where(~F.col("ok"))
    pairs = aspect_rows(batched, aspect_answers)
    expected = pairs.groupBy("batch_id").agg(F.count("*").alias("expected_n"))
    labels = check_response(expected, label_answers, True).where(~F.col("ok"))
    return aspects.select(F.lit("aspects").alias("step"), *aspects.columns).unionByName(
        labels.select(F.lit("labels").alias("step"), *labels.columns)
    )


def with_masks(rows: DataFrame, aspect_tokens: DataFrame, ids: str = "token_ids") -> DataFrame:
    """Aspect mask, type ids and attention; ``aspect_tokens`` has (aspect, aspect_ids)."""
    return (
        lookup_join(rows, aspect_tokens, ["aspect"], "left")
        .withColumn("aspect_mask", aspect_mask(ids, "aspect_ids"))
        .withColumn("token_type_ids", F.array_repeat(F.lit(0), F.array_size(ids)))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.array_size(ids)))
    )


def open_batches(
    base: DataFrame, done: DataFrame, key: str, text: str, size: int = K.LABELLING_BATCH
) -> DataFrame:
    """What is not done yet, cut into batches ``(key, text, batch_id, pos)``.

    Store the result before asking the model: answers refer to these numbers.
    Rows without a text are in :func:`without_text`, those without a key in
    ``shape.without_key``.
    """
    todo = shape.remaining(base, done, key).where(F.col(text).isNotNull())
    return shape.batches(todo.select(key, text), size, [key])


def without_text(base: DataFrame, done: DataFrame, key: str, text: str) -> DataFrame:
    """The quarantine of :func:`open_batches`: what is not done and has no text."""
    todo = shape.remaining(base, done, key).where(F.col(text).isNull())
    return todo.withColumn("reject_reason", F.lit("no text"))


def label_comments(
    base: DataFrame,
    batched: DataFrame,
    aspect_answers: DataFrame,
    label_answers: DataFrame,
    tokens: DataFrame,
    aspect_tokens: DataFrame,
    key: str = "comment_key",
    text: str = "text",
) -> DataFrame:
    """Full comment records with their label columns, ready to be appended.

    ``aspect_answers`` and ``label_answers`` are ``(batch_id, response)``,
    ``tokens`` is ``(key, token_ids)``, ``aspect_tokens`` is
    ``(aspect, aspect_ids)`` with one row per distinct aspect.
    """
    pairs = aspect_rows(batched, aspect_answers)
    labelled = label_rows(pairs, label_answers)
    masked = with_masks(shape.attach_tokens(labelled, tokens, key), aspect_tokens)
    rows = masked.withColumnRenamed(text, "raw_text").select(key, *LABELLED.fieldNames())
    return shape.attach_labels(rows, base, key)
