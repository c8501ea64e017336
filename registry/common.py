"""Inputs the registered queries share, and the SQL that repeats them.

The driver's tables hold no gold answers, annotations or model answers of the
kind the operators need.  They are derived from the tables by plain rules,
once as DataFrame expressions and once as SQL.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiloom.functions import text as X
from sentiloom.session import ensure_checkpoint_dir
from sentiloom.sources.tables import read_documents

# Lexicon and aspects of the queries: words that occur in the documents.
# Valences are multiples of 1/4, so sums are exact in any order.
LEXICON = {
    "best": 2.0, "rights": 1.0, "license": 0.5, "work": 0.5, "with": 0.5, "mit": 0.5,
    "avec": 0.5, "con": 0.5, "idiot": -3.0, "worthless": -2.5, "stupid": -2.0,
    "trash": -2.5, "scum": -3.0, "clown": -1.5, "moron": -3.0, "pathetic": -2.5,
    "loser": -2.0, "disgusting": -3.0, "no": -0.5, "not": -1.0, "from": -0.25,
}
ASPECTS = (
    "license", "licensed", "token", "work", "rights", "reserved", "best", "thatin",
    "thanedble", "enlich",
)
CONTEXT_ASPECT = "thatin"
SEP = "\u001f"


def registry():
    """Two dictionaries and the decorator that fills them."""
    queries, oracle = {}, {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn

        return add

    return queries, oracle, query


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sentiloom-{uuid4().hex}"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_documents(
        spark, f"{sf}/documents.parquet", "doc_id", list(columns or ("doc_id", "text"))
    )


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    from sentiloom.operators.lexicon import lexicon_table

    return lexicon_table(spark, LEXICON)


SQL_LEXICON = "lex(word, valence) AS (VALUES " + ", ".join(
    f"('{w}', CAST({v} AS DOUBLE))" for w, v in LEXICON.items()
) + ")"
SQL_STRUCT_WORDS = (
    "words AS (SELECT doc_id, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos,"
    " len(ws) AS n_words FROM (SELECT doc_id, regexp_extract_all(lower(text), '(\\p{L}+)') AS ws"
    " FROM documents))"
)
SQL_WORDS = SQL_STRUCT_WORDS
SQL_SENTENCES = (
    "sents AS (SELECT doc_id, unnest(ss) AS sentence, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS sent_id"
    " FROM (SELECT doc_id, regexp_extract_all(text, '([^.!?\\n]+[.!?]?)') AS ss FROM documents))"
)
SQL_BLANK = (
    "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)


def sql_compound(total: str) -> str:
    return f"({total}) / sqrt(({total}) * ({total}) + 15)"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_truncate(text: str, n: int = 275) -> str:
    return (
        f"array_to_string(list_filter(regexp_split_to_array({text}, '{SQL_BLANK}+'),"
        f" lambda w: w <> '')[1:{n}], ' ')"
    )


# Predictions by rule: gold from quality, implicit from toxic, the answer from
# words in the text.  Label 2 never is gold, so its class scores 0.
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower("text")
    answer = (
        F.when(F.contains(text, F.lit("best")), "</s>positive<pad>")
        .when(F.contains(text, F.lit("idiot")), " negative ")
        .when(F.contains(text, F.lit("worthless")), "It is Negative.")
        .when(F.contains(text, F.lit("stupid")), "unsure, neutral or negative")
        .when(F.contains(text, F.lit("tion the")), "neutral")
        .when(F.contains(text, F.lit("de la")), "negative")
        .otherwise("positive")
    )
    return (
        docs(spark, sf, "doc_id", "text", "lang", "source")
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            "doc_id",
            "lang",
            "source",
            F.when(F.col("quality") == 1, 0).otherwise(1).alias("gold"),
            F.col("toxic").alias("implicit"),
            answer.alias("answer"),
        )
    )


SQL_PREDICTIONS = """preds AS (SELECT doc_id, lang, source,
  CASE WHEN quality = 1 THEN 0 ELSE 1 END AS gold, toxic AS implicit,
  CASE WHEN contains(lower(text), 'best') THEN '</s>positive<pad>'
       WHEN contains(lower(text), 'idiot') THEN ' negative '
       WHEN contains(lower(text), 'worthless') THEN 'It is Negative.'
       WHEN contains(lower(text), 'stupid') THEN 'unsure, neutral or negative'
       WHEN contains(lower(text), 'tion the') THEN 'neutral'
       WHEN contains(lower(text), 'de la') THEN 'negative'
       ELSE 'positive' END AS answer
  FROM documents JOIN labels USING (doc_id))"""


def sql_exact(answer: str) -> str:
    clean = sql_strip(f"replace(replace({answer}, '<pad>', ''), '</s>', '')")
    return f"(CASE {clean} WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 WHEN 'neutral' THEN 2 ELSE 0 END)"


def sql_contains(answer: str) -> str:
    low = f"lower({answer})"
    return (
        f"(CASE WHEN contains({low}, 'positive') THEN 0 WHEN contains({low}, 'negative') THEN 1"
        f" WHEN contains({low}, 'neutral') THEN 2 ELSE 2 END)"
    )


SQL_SCORED = f"scored AS (SELECT *, {sql_contains('answer')} AS pred FROM preds)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    from sentiloom.functions.responses import decode_contains

    return predictions(spark, sf).withColumn("pred", decode_contains("answer"))


def sql_macro(among: str = "TRUE") -> str:
    def f1(c: int) -> str:
        tp = f"count(*) FILTER (WHERE {among} AND gold = {c} AND pred = {c})"
        den = (
            f"(count(*) FILTER (WHERE {among} AND gold = {c})"
            f" + count(*) FILTER (WHERE {among} AND pred = {c}))"
        )
        return f"CASE WHEN {den} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {tp} / {den} END"

    return "round(100 * (" + " + ".join(f"({f1(c)})" for c in (0, 1, 2)) + ") / 3, 3)"


# Labelled rows by rule: each aspect of the list that the text holds, or one row
# without any; word lengths of the whole text as token ids.
def ids_of(text) -> F.Column:
    return F.transform(X.words(text), lambda w: F.length(w))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    held = X.contained("text", ASPECTS)
    aspects = F.when(F.size(held) > 0, held).otherwise(F.array(F.lit("NONE")))
    return (
        docs(spark, sf, "doc_id", "text")
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            "doc_id",
            F.col("text").alias("raw_text"),
            F.explode(aspects).alias("aspect"),
            ids_of("text").alias("token_ids"),
            F.transform(ids_of("text"), lambda n: (n > 6).cast("int")).alias("aspect_mask"),
            (F.col("toxic") == 1).alias("implicitness"),
            F.when(F.col("quality") == 1, 0).otherwise(1).alias("polarity"),
        )
    )


SQL_HELD = "list_filter([" + sql_list(ASPECTS) + "], lambda a: contains(text, a))"
SQL_LABELLED = f"""labelled AS (SELECT doc_id, text AS raw_text, unnest(CASE WHEN len({SQL_HELD}) = 0 THEN ['NONE'] ELSE {SQL_HELD} END) AS aspect,
  list_transform(regexp_extract_all(lower(text), '(\\p{{L}}+)'), lambda w: length(w)) AS token_ids,
  list_transform(regexp_extract_all(lower(text), '(\\p{{L}}+)'),
    lambda w: CASE WHEN length(w) > 6 THEN 1 ELSE 0 END) AS aspect_mask,
  toxic = 1 AS implicitness, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS polarity
  FROM documents JOIN labels USING (doc_id))"""


def joined(array, sep: str = ",") -> F.Column:
    """An array as text, so that both engines hash the same value."""
    return F.array_join(array, sep)
