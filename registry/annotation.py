"""Queries over a token annotation made from the documents by rule.

Adjectives are a few frequent words, nouns are long words, an adjective
depends on the token after it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import common as C
from sentiloom.functions import text as X
from sentiloom.operators import annotation as A

QUERIES, ORACLE, query = C.registry()
ADJECTIVES = ("the", "la", "die", "der", "el", "le", "best", "stupid", "worthless")


def annotation(spark, sf):
    sents = C.docs(spark, sf).select("doc_id", F.posexplode(X.sentences("text")).alias("sent_id", "sentence"))
    toks = sents.select("doc_id", "sent_id", F.posexplode(X.words("sentence", lower=False)).alias("i", "text"))
    lemma = F.lower("text")
    n = F.length("text")
    upos = F.when(lemma.isin(*ADJECTIVES), "ADJ").when(n >= 6, "NOUN").otherwise("X")
    noun = F.col("upos") == "NOUN"
    tok = F.col("i") + 1
    return (
        toks.withColumn("upos", upos)
        .select(
            "doc_id",
            "sent_id",
            tok.alias("tok_id"),
            "text",
            lemma.alias("lemma"),
            "upos",
            F.when(F.col("upos") == "ADJ", tok + 1).otherwise(0).alias("head"),
            F.when(noun & (tok <= 4), "nsubj").when(noun & (n >= 9), "nmod").when(noun, "dobj").otherwise("dep").alias("deprel"),
            F.when((F.col("text") != lemma) & (tok > 1), "ENT").alias("ner"),
        )
    )


SQL_TOKENS = f"""{C.SQL_SENTENCES},
  raw AS (SELECT doc_id, sent_id, unnest(ws) AS text, CAST(generate_subscripts(ws, 1) AS INTEGER) AS tok_id FROM
    (SELECT doc_id, sent_id, regexp_extract_all(sentence, '(\\p{{L}}+)') AS ws FROM sents)),
  u AS (SELECT *, lower(text) AS lemma, CASE WHEN lower(text) IN ({C.sql_list(ADJECTIVES)}) THEN 'ADJ'
    WHEN length(text) >= 6 THEN 'NOUN' ELSE 'X' END AS upos FROM raw),
  toks AS (SELECT *, CASE WHEN upos = 'ADJ' THEN tok_id + 1 ELSE 0 END AS head,
    CASE WHEN upos <> 'NOUN' THEN 'dep' WHEN tok_id <= 4 THEN 'nsubj' WHEN length(text) >= 9 THEN 'nmod'
    ELSE 'dobj' END AS deprel, CASE WHEN text <> lemma AND tok_id > 1 THEN 'ENT' END AS ner FROM u)"""


@query(
    "aspect_candidates",
    f"""WITH {SQL_TOKENS} SELECT doc_id, sent_id, tok_id, text AS aspect FROM toks
    WHERE deprel IN ('nsubj', 'dobj', 'attr', 'nmod') AND upos = 'NOUN'""",
)
def aspect_candidates(spark, sf):
    return A.aspect_candidates(annotation(spark, sf))


@query(
    "aspect_opinion_pairs",
    f"""WITH {SQL_TOKENS} SELECT n.doc_id, n.sent_id, n.tok_id, n.text AS aspect, o.tok_id AS opinion_tok_id,
    o.text AS opinion FROM toks n JOIN toks o ON n.doc_id = o.doc_id AND n.sent_id = o.sent_id AND o.head = n.tok_id
    WHERE n.deprel IN ('nsubj', 'dobj') AND n.upos = 'NOUN' AND o.upos = 'ADJ'""",
)
def aspect_opinion_pairs(spark, sf):
    return A.aspect_opinion_pairs(annotation(spark, sf))


@query(
    "opinion_of",
    f"""WITH {SQL_TOKENS}, hit AS (SELECT n.doc_id, o.text AS opinion, row_number() OVER (PARTITION BY n.doc_id
      ORDER BY n.sent_id, n.tok_id, o.tok_id) AS r FROM toks n JOIN toks o ON n.doc_id = o.doc_id
      AND n.sent_id = o.sent_id AND o.head = n.tok_id WHERE n.lemma = '{C.CONTEXT_ASPECT}' AND o.upos = 'ADJ')
    SELECT t.doc_id, coalesce(opinion, 'False') AS opinion FROM (SELECT DISTINCT doc_id FROM toks) t
    LEFT JOIN (SELECT * FROM hit WHERE r = 1) h USING (doc_id)""",
)
def opinion_of(spark, sf):
    return A.opinion_of(annotation(spark, sf), C.CONTEXT_ASPECT.upper())


@query(
    "opinion_of_rows",
    f"""WITH {SQL_TOKENS}, r AS (SELECT DISTINCT doc_id, text AS aspect FROM toks WHERE upos = 'NOUN' AND sent_id = 0),
    hit AS (SELECT r.doc_id, r.aspect, o.text AS opinion, row_number() OVER (PARTITION BY r.doc_id, r.aspect
      ORDER BY n.sent_id, n.tok_id, o.tok_id) AS k FROM r JOIN toks n ON n.doc_id = r.doc_id AND n.lemma = lower(r.aspect)
      JOIN toks o ON n.doc_id = o.doc_id AND n.sent_id = o.sent_id AND o.head = n.tok_id WHERE o.upos = 'ADJ')
    SELECT r.doc_id, r.aspect, coalesce(opinion, 'False') AS opinion FROM r
    LEFT JOIN (SELECT * FROM hit WHERE k = 1) h USING (doc_id, aspect)""",
)
def opinion_of_rows(spark, sf):
    """Aspects are the nouns of a document's first sentence."""
    tokens = annotation(spark, sf)
    rows = tokens.where("upos = 'NOUN' AND sent_id = 0").select("doc_id", F.col("text").alias("aspect")).distinct()
    return A.opinion_of_rows(tokens, rows)


LISTED = ", ".join(
    f"string_agg(coalesce({c}::VARCHAR, '_'), ' ' ORDER BY sent_id, tok_id) AS {c}_list" for c in A.LISTS
)


def _text_lists(df, keys):
    return df.select(
        *keys, *[F.array_join(F.col(f"{c}_list").cast("array<string>"), " ", "_").alias(f"{c}_list") for c in A.LISTS]
    )


@query("annotation_lists", f"WITH {SQL_TOKENS} SELECT doc_id, {LISTED} FROM toks GROUP BY doc_id")
def annotation_lists(spark, sf):
    return _text_lists(A.annotation_lists(annotation(spark, sf)), ["doc_id"])


@query(
    "annotation_lists_by_sentence",
    f"WITH {SQL_TOKENS} SELECT doc_id, sent_id, {LISTED} FROM toks GROUP BY doc_id, sent_id",
)
def annotation_lists_by_sentence(spark, sf):
    return _text_lists(A.annotation_lists(annotation(spark, sf), per_sentence=True), ["doc_id", "sent_id"])
