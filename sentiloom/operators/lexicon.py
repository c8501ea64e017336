"""Sentiment operators over token tables and a lexicon the caller supplies.

The score is the plain sum of valences, squashed.  It serves the purpose of a
rule-based scorer but does not claim the same numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiloom import constants as K
from sentiloom.functions import text as X
from sentiloom.operators.scale import fits_broadcast, lookup_join
from sentiloom.operators.terms import terms_in

START_CHARS = 6


def lexicon_table(spark: SparkSession, lexicon: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(list(lexicon.items()), "word string, valence double")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """Word rows ``(key, pos, word)``."""
    return docs.select(key, F.posexplode(X.words(text, lower)).alias("pos", "word"))


def content_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, pos, word)`` of words and numbers in lower case."""
    return docs.select(key, F.posexplode(X.alphanumerics(text)).alias("pos", "word"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentence rows ``(key, sent_id, sentence)``."""
    return docs.select(key, F.posexplode(X.sentences(text)).alias("sent_id", "sentence"))


def content_words(rows: DataFrame, stop: Sequence[str] | DataFrame = K.STOP_WORDS) -> DataFrame:
    """Word rows without stop words, given as a list or as a table ``(word)``."""
    if isinstance(stop, DataFrame):
        return lookup_join(rows, stop.select("word").distinct(), ["word"], "left_anti")
    return rows.where(~F.col("word").isin(*stop))


def lexicon_hits(rows: DataFrame, lexicon: DataFrame, how: str = "inner") -> DataFrame:
    """Word rows with the valence of their word."""
    return lookup_join(rows, lexicon, ["word"], how)


def score_text(
    df: DataFrame, keys: list[str], text: str | Column, lexicon: DataFrame, name: str = "compound"
) -> DataFrame:
    """Compound score of a text per key; a text without hits scores 0.

    All words of a row sit in one task, so the sum is complete before the
    shuffle: one small row per key moves, no text.
    """
    rows = df.select(*keys, F.explode_outer(X.words(text)).alias("word"))
    return (
        lexicon_hits(rows, lexicon, "left")
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("_sum"))
        .select(*keys, X.compound(F.col("_sum")).alias(name))
    )


def compound(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return score_text(docs, [key], text, lexicon)


def aspects_present(
    docs: DataFrame, aspects: Sequence[str] | DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows ``(key, aspect)`` for each aspect that is part of the text.

    The terms of a list are tested inside the row.  Those of a table
    ``(aspect)`` that fits a broadcast go to every task, which looks them up at
    all places of its texts.  Those of a larger one are joined: the first
    characters of every place of the text find the terms that may begin there,
    and the text decides.  In each way a term counts once, and empty and NULL
    terms never.
    """
    if not isinstance(aspects, DataFrame):
        terms = [a for a in dict.fromkeys(aspects) if a]
        return docs.select(key, F.explode(X.contained(text, terms)).alias("aspect"))
    listed = aspects.where(F.length("aspect") > 0).select("aspect").distinct()
    if fits_broadcast(listed):
        terms = [r["aspect"] for r in listed.collect()]  # measured just before
        return terms_in(docs, terms, key, text) if terms else docs.select(key, F.lit("").alias("aspect")).limit(0)
    return _aspects_by_start(docs, listed, key, text)


def _aspects_by_start(docs: DataFrame, aspects: DataFrame, key: str, text: str) -> DataFrame:
    """The same for any number of different terms."""
    size = F.least(F.length("aspect"), F.lit(START_CHARS))
    terms = aspects.select("aspect", F.substr("aspect", F.lit(1), size).alias("start"))
    sizes = terms.agg(F.collect_set(F.length("start"))).scalar()  # at most START_CHARS values

    def pieces(chars: Column) -> Column:
        return F.array_distinct(
            F.transform(chars, lambda _, i: F.array_join(F.slice(chars, i + 1, START_CHARS), ""))
        )

    starts = (
        docs.select(key, sizes.alias("_sizes"), F.explode(X.let(F.split(text, ""), pieces)).alias("piece"))
        .select(key, "piece", F.explode("_sizes").alias("_n"))
        .where(F.length("piece") >= F.col("_n"))
        .select(key, F.substr("piece", F.lit(1), F.col("_n")).alias("start"))
    )
    may = lookup_join(starts, terms, ["start"]).select(key, "aspect").distinct()
    held = docs.select(key, F.col(text).alias("_text")).join(may, key)
    return held.where(F.contains("_text", "aspect")).select(key, "aspect")


def aspect_sentiment_rows(
    rows: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", aspect: str = "aspect"
) -> DataFrame:
    """``(key, aspect, sentiment)``: score of the first sentence that holds the row's aspect.

    Each row brings its own aspect.  Where no sentence holds it, as it crosses
    a sentence end or is not in the text, the score is NULL.  Rows are one
    (key, aspect) each.
    """
    found = rows.select(key, aspect, X.first_sentence_with(text, F.col(aspect)).alias("_sent"))
    words = found.select(
        key,
        aspect,
        F.col("_sent").isNotNull().alias("_held"),
        F.explode_outer(X.words("_sent")).alias("word"),
    )
    return (
        lexicon_hits(words, lexicon, "left")
        .groupBy(key, aspect)
        .agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("_sum"), F.max("_held").alias("_held"))
        .select(key, aspect, F.when(F.col("_held"), X.compound(F.col("_sum"))).alias("sentiment"))
    )


def aspect_sentiment(
    docs: DataFrame, aspects: Sequence[str], lexicon: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The same for each aspect of a list that is part of the text."""
    held = docs.select(key, F.col(text).alias("_text"), F.explode(X.contained(text, aspects)).alias("aspect"))
    return aspect_sentiment_rows(held, lexicon, key, "_text")


def context_sentiment_rows(
    rows: DataFrame,
    lexicon: DataFrame,
    size: int = K.CONTEXT_WINDOW,
    key: str = "doc_id",
    text: str = "text",
    aspect: str = "aspect",
) -> DataFrame:
    """``(key, aspect, context, sentiment)`` around the first token that is the row's aspect.

    NULL if there is none.  Rows are one (key, aspect) each.
    """
    windows = rows.select(key, aspect, X.context_window(text, F.col(aspect), size).alias("context"))
    words = windows.select(key, aspect, "context", F.explode_outer(X.words("context")).alias("word"))
    return (
        lexicon_hits(words, lexicon, "left")
        .groupBy(key, aspect)
        .agg(F.first("context", True).alias("context"), F.coalesce(F.sum("valence"), F.lit(0.0)).alias("_sum"))
        .select(
            key,
            aspect,
            "context",
            F.when(F.col("context").isNotNull(), X.compound(F.col("_sum"))).alias("sentiment"),
        )
    )


def context_sentiment(
    docs: DataFrame,
    aspect: str,
    lexicon: DataFrame,
    size: int = K.CONTEXT_WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The same for one aspect that all rows are asked for."""
    rows = docs.select(key, F.col(text).alias("_text"), F.lit(aspect).alias("_aspect"))
    return context_sentiment_rows(rows, lexicon, size, key, "_text", "_aspect").drop("_aspect")


def mark_modifiers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, X.mark_modifiers(text).alias("marked"))


def sarcasm(
    docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", level: float = K.SARCASM_LEVEL
) -> DataFrame:
    """Does a strongly worded sentence contradict the text as a whole?

    Sentence sums add up to the sum of the text, so one pass over the words
    serves both.  Only sentences with a hit are shuffled; texts without any
    come back through their keys.
    """
    sents = sentences(docs, key, text)
    words = sents.select(key, "sent_id", F.explode(X.words("sentence")).alias("word"))
    per_sentence = (
        lexicon_hits(words, lexicon).groupBy(key, "sent_id").agg(F.sum("valence").alias("_s"))
    )
    everyone = docs.select(key, F.lit(0.0).alias("_s"))
    score = X.compound(F.col("_s"))
    whole = F.sum("_s")
    conflict = ((whole > 0) & (F.min(score) < -level)) | ((whole < 0) & (F.max(score) > level))
    return (
        per_sentence.select(key, "_s")
        .unionByName(everyone)
        .groupBy(key)
        .agg(
            X.compound(F.sum("_s")).alias("overall"),
            F.when(conflict, K.SARCASM).otherwise(K.NO_SARCASM).alias("verdict"),
        )
    )
