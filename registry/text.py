"""Queries: tokens, lexicon sentiment, vocabulary and information metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import common as C
from sentiloom import constants as K
from sentiloom.functions import text as X
from sentiloom.operators import counts as N
from sentiloom.operators import information as I
from sentiloom.operators import lexicon as L
from sentiloom.operators import shape as S
from sentiloom.operators.scale import dense_index

QUERIES, ORACLE, query = C.registry()


@query("tokens", f"WITH {C.SQL_WORDS} SELECT doc_id, pos, word FROM words")
def tokens(spark, sf):
    return L.tokens(C.docs(spark, sf))


@query(
    "tokens_cased",
    """SELECT doc_id, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, '(\\p{L}+)') AS ws FROM documents)""",
)
def tokens_cased(spark, sf):
    return L.tokens(C.docs(spark, sf), lower=False)


@query("sentences", f"WITH {C.SQL_SENTENCES} SELECT doc_id, sent_id, sentence FROM sents")
def sentences(spark, sf):
    return L.sentences(C.docs(spark, sf))


ALNUM = (
    "alnum AS (SELECT doc_id, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos"
    " FROM (SELECT doc_id, regexp_extract_all(lower(text), '(\\p{L}+|\\p{N}+)') AS ws FROM documents))"
)


@query(
    "content_words",
    f"WITH {ALNUM} SELECT doc_id, pos, word FROM alnum WHERE word NOT IN ({C.sql_list(K.STOP_WORDS)})",
)
def content_words(spark, sf):
    return L.content_words(L.content_tokens(C.docs(spark, sf)))


@query(
    "content_words_table",
    f"""WITH {ALNUM}, stop AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{{L}}+)'))
    AS word FROM benchmark) SELECT doc_id, pos, word FROM alnum ANTI JOIN stop USING (word)""",
)
def content_words_table(spark, sf):
    stop = C.table(spark, sf, "benchmark").select(F.explode(X.words("text")).alias("word"))
    return L.content_words(L.content_tokens(C.docs(spark, sf)), stop).select("doc_id", "pos", "word")


@query(
    "vocabulary",
    f"""WITH {C.SQL_WORDS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df,
    row_number() OVER (ORDER BY word) - 1 AS id FROM words GROUP BY word""",
)
def vocabulary(spark, sf):
    return I.vocabulary(C.docs(spark, sf))


def kept_counts(spark, sf):
    """All documents as three batches: two merged, the second of them tried again, the last one added after that."""
    path, docs = C.scratch(spark), C.docs(spark, sf, "doc_id", "text", "source")
    batch = lambda i: docs.where(F.pmod(F.hash("source"), F.lit(3)) == i).select("text")
    for i in (0, 1, 1):
        N.add_batch(batch(i), path, f"load {i}")
    N.compact(spark, path)
    for i in (1, 2):
        N.add_batch(batch(i), path, f"load {i}")
    return path


@query(
    "kept_vocabulary",
    f"""WITH {C.SQL_WORDS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df,
    row_number() OVER (ORDER BY word) - 1 AS id FROM words GROUP BY word""",
)
def kept_vocabulary(spark, sf):
    return N.kept_vocabulary(spark, kept_counts(spark, sf))


@query(
    "kept_pairs",
    f"""WITH {C.SQL_WORDS}, p AS (SELECT word AS v, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS w FROM words)
    SELECT v, w, count(*) AS n FROM p WHERE w IS NOT NULL GROUP BY v, w""",
)
def kept_pairs(spark, sf):
    return N.kept_pairs(spark, kept_counts(spark, sf))


@query("bow", f"WITH {C.SQL_WORDS} SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word")
def bow(spark, sf):
    return I.bow(C.docs(spark, sf))


@query("truncate_words", f"SELECT doc_id, {C.sql_truncate('text')} AS line FROM documents")
def truncate_words(spark, sf):
    return C.docs(spark, sf).select("doc_id", X.truncate_words("text").alias("line"))


@query("read_text_column", "SELECT text FROM documents")
def read_text_column(spark, sf):
    return S.read_text_column(C.table(spark, sf, "documents"), "text")


@query(
    "lexicon_hits",
    f"WITH {C.SQL_LEXICON}, {C.SQL_WORDS} SELECT doc_id, pos, word, valence FROM words JOIN lex USING (word)",
)
def lexicon_hits(spark, sf):
    return L.lexicon_hits(L.tokens(C.docs(spark, sf)), C.lexicon(spark))


@query(
    "aspects_present",
    f"SELECT doc_id, unnest({C.SQL_HELD}) AS aspect FROM documents",
)
def aspects_present(spark, sf):
    return L.aspects_present(C.docs(spark, sf), C.ASPECTS)


@query(
    "aspects_present_table",
    """WITH terms AS (SELECT DISTINCT aspect FROM (SELECT unnest(regexp_extract_all(text, '(\\p{L}+)'))
    AS aspect FROM benchmark))
    SELECT doc_id, aspect FROM documents JOIN terms ON contains(text, aspect)""",
)
def aspects_present_table(spark, sf):
    terms = (
        C.table(spark, sf, "benchmark")
        .select(F.explode(X.words("text", lower=False)).alias("aspect"))
        .distinct()
    )
    return L.aspects_present(C.docs(spark, sf), terms)


@query(
    "compound",
    f"""WITH {C.SQL_LEXICON}, {C.SQL_WORDS}, sums AS (SELECT doc_id, sum(valence) AS s
    FROM words JOIN lex USING (word) GROUP BY doc_id)
    SELECT d.doc_id, round({C.sql_compound('coalesce(s, 0)')}, 4) AS compound
    FROM documents d LEFT JOIN sums USING (doc_id)""",
)
def compound(spark, sf):
    out = L.compound(C.docs(spark, sf), C.lexicon(spark))
    return out.select("doc_id", F.round("compound", 4).alias("compound"))


@query(
    "aspect_sentiment",
    f"""WITH {C.SQL_LEXICON},
    held AS (SELECT doc_id, unnest({C.SQL_HELD}) AS aspect, text FROM documents),
    firsts AS (SELECT doc_id, aspect, list_filter(regexp_extract_all(text, '([^.!?\\n]+[.!?]?)'),
      lambda s: contains(s, aspect))[1] AS sentence FROM held),
    hits AS (SELECT doc_id, aspect, sum(valence) AS s FROM (SELECT doc_id, aspect,
      unnest(regexp_extract_all(lower(sentence), '(\\p{{L}}+)')) AS word FROM firsts) JOIN lex USING (word)
      GROUP BY doc_id, aspect)
    SELECT f.doc_id, f.aspect, CASE WHEN sentence IS NOT NULL THEN
      round({C.sql_compound('coalesce(s, 0)')}, 4) END AS sentiment
    FROM firsts f LEFT JOIN hits USING (doc_id, aspect)""",
)
def aspect_sentiment(spark, sf):
    out = L.aspect_sentiment(C.docs(spark, sf), C.ASPECTS, C.lexicon(spark))
    return out.withColumn("sentiment", F.round("sentiment", 4))


SURFACE = "regexp_extract_all(text, '([\\p{L}]+(?:[''’][\\p{L}]+)*|\\p{N}+|[^\\s\\p{L}\\p{N}])')"


@query(
    "context_sentiment",
    f"""WITH {C.SQL_LEXICON},
    toks AS (SELECT doc_id, {SURFACE} AS ts FROM documents),
    spans AS (SELECT doc_id, ts, list_position(ts, '{C.CONTEXT_ASPECT}') AS hit FROM toks),
    ctx AS (SELECT doc_id, CASE WHEN hit > 0 THEN
      array_to_string(ts[greatest(hit - 5, 1):hit + 5], ' ') END AS context FROM spans),
    hits AS (SELECT doc_id, sum(valence) AS s FROM (SELECT doc_id,
      unnest(regexp_extract_all(lower(context), '(\\p{{L}}+)')) AS word FROM ctx) JOIN lex USING (word)
      GROUP BY doc_id)
    SELECT c.doc_id, context, CASE WHEN context IS NOT NULL THEN
      round({C.sql_compound('coalesce(s, 0)')}, 4) END AS sentiment
    FROM ctx c LEFT JOIN hits USING (doc_id)""",
)
def context_sentiment(spark, sf):
    out = L.context_sentiment(C.docs(spark, sf), C.CONTEXT_ASPECT, C.lexicon(spark))
    return out.withColumn("sentiment", F.round("sentiment", 4))


# Rows that bring their own aspect: the first word of the text's last sentence.
OWN = (
    "own AS (SELECT doc_id, text, regexp_extract_all(regexp_extract_all(text, '([^.!?\\n]+[.!?]?)')[-1], '(\\p{L}+)')[1]"
    " AS aspect FROM documents)"
)


def own_aspects(spark, sf):
    last = F.element_at(X.sentences("text"), -1)
    first = F.get(X.words(F.when(F.size(X.sentences("text")) > 0, last), lower=False), F.lit(0))
    return C.docs(spark, sf).withColumn("aspect", first)


@query(
    "aspect_sentiment_rows",
    f"""WITH {C.SQL_LEXICON}, {OWN},
    firsts AS (SELECT doc_id, aspect, list_filter(regexp_extract_all(text, '([^.!?\\n]+[.!?]?)'),
      lambda s: contains(s, aspect))[1] AS sentence FROM own),
    hits AS (SELECT doc_id, sum(valence) AS s FROM (SELECT doc_id,
      unnest(regexp_extract_all(lower(sentence), '(\\p{{L}}+)')) AS word FROM firsts) JOIN lex USING (word) GROUP BY doc_id)
    SELECT f.doc_id, f.aspect, CASE WHEN sentence IS NOT NULL THEN round({C.sql_compound('coalesce(s, 0)')}, 4) END AS sentiment
    FROM firsts f LEFT JOIN hits USING (doc_id)""",
)
def aspect_sentiment_rows(spark, sf):
    out = L.aspect_sentiment_rows(own_aspects(spark, sf), C.lexicon(spark))
    return out.withColumn("sentiment", F.round("sentiment", 4))


@query(
    "context_sentiment_rows",
    f"""WITH {C.SQL_LEXICON}, {OWN},
    toks AS (SELECT doc_id, aspect, {SURFACE} AS ts FROM own),
    spans AS (SELECT doc_id, aspect, ts, list_position(ts, aspect) AS hit FROM toks),
    ctx AS (SELECT doc_id, aspect, CASE WHEN hit > 0 THEN
      array_to_string(ts[greatest(hit - 5, 1):hit + 5], ' ') END AS context FROM spans),
    hits AS (SELECT doc_id, sum(valence) AS s FROM (SELECT doc_id,
      unnest(regexp_extract_all(lower(context), '(\\p{{L}}+)')) AS word FROM ctx) JOIN lex USING (word) GROUP BY doc_id)
    SELECT c.doc_id, aspect, context, CASE WHEN context IS NOT NULL THEN
      round({C.sql_compound('coalesce(s, 0)')}, 4) END AS sentiment
    FROM ctx c LEFT JOIN hits USING (doc_id)""",
)
def context_sentiment_rows(spark, sf):
    out = L.context_sentiment_rows(own_aspects(spark, sf), C.lexicon(spark))
    return out.withColumn("sentiment", F.round("sentiment", 4))


@query(
    "mark_modifiers",
    f"""WITH toks AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
      FROM (SELECT doc_id, {SURFACE} AS ts FROM documents)),
    kinds AS (SELECT *, CASE WHEN lower(t) IN ({C.sql_list(K.NEGATIONS)}) THEN 1
      WHEN lower(t) IN ({C.sql_list(K.INTENSIFIERS)}) THEN 2 ELSE 0 END AS kind FROM toks),
    runs AS (SELECT *, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM kinds),
    flags AS (SELECT *, max(CAST(kind = 1 AS INT)) OVER (PARTITION BY doc_id, run) AS neg,
      max(CAST(kind = 2 AS INT)) OVER (PARTITION BY doc_id, run) AS ins FROM runs),
    out AS (SELECT doc_id, i, CASE WHEN kind > 0 THEN t ELSE
      CASE WHEN ins = 1 THEN 'INTENSIFIED_' ELSE '' END || CASE WHEN neg = 1 THEN 'NOT_' ELSE '' END || t
      END AS t FROM flags)
    SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS marked
    FROM documents d LEFT JOIN out USING (doc_id) GROUP BY d.doc_id""",
)
def mark_modifiers(spark, sf):
    return L.mark_modifiers(C.docs(spark, sf))


@query(
    "sarcasm",
    f"""WITH {C.SQL_LEXICON}, {C.SQL_SENTENCES},
    ws AS (SELECT doc_id, sent_id, unnest(regexp_extract_all(lower(sentence), '(\\p{{L}}+)')) AS word FROM sents),
    per AS (SELECT doc_id, sent_id, sum(valence) AS s FROM ws JOIN lex USING (word) GROUP BY ALL),
    agg AS (SELECT doc_id, sum(s) AS total, min({C.sql_compound('s')}) AS lo, max({C.sql_compound('s')}) AS hi
      FROM per GROUP BY doc_id)
    SELECT d.doc_id, round({C.sql_compound('coalesce(total, 0)')}, 4) AS overall,
      CASE WHEN (total > 0 AND lo < -0.5) OR (total < 0 AND hi > 0.5)
      THEN 'Potential Sarcasm detected' ELSE 'No sarcasm detected' END AS verdict
    FROM documents d LEFT JOIN agg USING (doc_id)""",
)
def sarcasm(spark, sf):
    out = L.sarcasm(C.docs(spark, sf), C.lexicon(spark))
    return out.withColumn("overall", F.round("overall", 4))


@query(
    "entropy",
    f"""WITH {C.SQL_WORDS}, c AS (SELECT doc_id, word, count(*) AS k, any_value(n_words) AS n
      FROM words GROUP BY doc_id, word),
    e AS (SELECT doc_id, -sum((k::DOUBLE / n) * log2(k::DOUBLE / n)) AS h FROM c GROUP BY doc_id)
    SELECT d.doc_id, round(h, 5) + 0.0 AS shannon_entropy FROM documents d LEFT JOIN e USING (doc_id)""",
)
def entropy(spark, sf):
    out = I.entropy(C.docs(spark, sf))
    return out.select("doc_id", (F.round("shannon_entropy", 5) + 0.0).alias("shannon_entropy"))


UNIGRAM = f"""{C.SQL_WORDS}, c AS (SELECT word, count(*) AS n FROM words GROUP BY word),
  tot AS (SELECT sum(n)::DOUBLE AS big_n, count(*)::DOUBLE AS v FROM c),
  uni AS (SELECT doc_id, avg(-log2(n / big_n)) AS surprisal FROM words JOIN c USING (word), tot GROUP BY doc_id)"""
BIGRAM = """pr AS (SELECT doc_id, word AS v_word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS w_word FROM words),
  pc AS (SELECT v_word, w_word, count(*) AS n FROM pr WHERE w_word IS NOT NULL GROUP BY v_word, w_word),
  pt AS (SELECT sum(n)::DOUBLE AS p FROM pc),
  ctx AS (SELECT doc_id, avg(-log2((pc.n + 1) / (c1.n + v))) AS cs,
    avg(log2((pc.n / p) / ((c1.n / big_n) * (c2.n / big_n)))) AS cm
    FROM pr JOIN pc USING (v_word, w_word) JOIN c c1 ON c1.word = v_word JOIN c c2 ON c2.word = w_word, tot, pt
    GROUP BY doc_id)"""


@query(
    "unigram_lm",
    f"""WITH {UNIGRAM} SELECT doc_id, round(surprisal, 5) AS surprisal,
    round(pow(2, surprisal), 2) AS perplexity FROM uni""",
)
def unigram_lm(spark, sf):
    return I.unigram_lm(C.docs(spark, sf)).select(
        "doc_id", F.round("surprisal", 5).alias("surprisal"), F.round("perplexity", 2).alias("perplexity")
    )


@query(
    "bigram_lm",
    f"""WITH {UNIGRAM}, {BIGRAM} SELECT u.doc_id, round(cm, 5) AS contextual_mutual_information_score,
    round(cs, 5) AS contextual_surprisal, round(pow(2, cs), 2) AS contextual_perplexity
    FROM uni u LEFT JOIN ctx USING (doc_id)""",
)
def bigram_lm(spark, sf):
    return I.bigram_lm(C.docs(spark, sf)).select(
        "doc_id",
        F.round("contextual_mutual_information_score", 5).alias("contextual_mutual_information_score"),
        F.round("contextual_surprisal", 5).alias("contextual_surprisal"),
        F.round("contextual_perplexity", 2).alias("contextual_perplexity"),
    )


PMI = f"""dw AS (SELECT DISTINCT doc_id, word FROM words),
  dfs AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
  jt AS (SELECT a.doc_id, a.word AS aspect, b.word FROM dw a JOIN dw b USING (doc_id)
    WHERE a.word IN ({C.sql_list(C.ASPECTS)}) AND a.word <> b.word),
  jc AS (SELECT aspect, word, count(*) AS n FROM jt GROUP BY aspect, word),
  dn AS (SELECT count(*)::DOUBLE AS d FROM documents),
  pmi AS (SELECT doc_id, jt.aspect, avg(log2(d * jc.n / (fa.n * fw.n))) AS mi
    FROM jt JOIN jc USING (aspect, word) JOIN dfs fw ON fw.word = jt.word
    JOIN dfs fa ON fa.word = jt.aspect, dn GROUP BY doc_id, jt.aspect)"""


@query(
    "aspect_pmi",
    f"WITH {C.SQL_WORDS}, {PMI} SELECT doc_id, aspect, round(mi, 5) AS mutual_information_score FROM pmi",
)
def aspect_pmi(spark, sf):
    out = I.aspect_pmi(C.docs(spark, sf), C.ASPECTS)
    return out.withColumn("mutual_information_score", F.round("mutual_information_score", 5))


METRICS = f"""WITH {UNIGRAM}, {BIGRAM}, {PMI},
  cc AS (SELECT doc_id, word, count(*) AS k, any_value(n_words) AS n FROM words GROUP BY doc_id, word),
  ent AS (SELECT doc_id, -sum((k::DOUBLE / n) * log2(k::DOUBLE / n)) AS h FROM cc GROUP BY doc_id)
  SELECT d.doc_id, aspect, round(h, 5) + 0.0 AS shannon_entropy, round(mi, 5) AS mutual_information_score,
    round(surprisal, 5) AS surprisal, round(pow(2, surprisal), 2) AS perplexity,
    round(cm, 5) AS contextual_mutual_information_score, round(cs, 5) AS contextual_surprisal,
    round(pow(2, cs), 2) AS contextual_perplexity
  FROM documents d LEFT JOIN ent USING (doc_id) LEFT JOIN uni USING (doc_id)
    LEFT JOIN ctx USING (doc_id) LEFT JOIN pmi USING (doc_id)"""


def _rounded(df):
    cut = {"perplexity": 2, "contextual_perplexity": 2}
    return df.select(
        "doc_id",
        "aspect",
        *[
            (F.round(c, cut.get(c, 5)) + 0.0).alias(c)
            for c in (
                "shannon_entropy", "mutual_information_score", "surprisal", "perplexity",
                "contextual_mutual_information_score", "contextual_surprisal", "contextual_perplexity",
            )
        ],
    )


OWN_DOCS = "WITH documents AS (SELECT d.* FROM main.documents d JOIN labels USING (doc_id)), "
OWN_PMI = """dw AS (SELECT DISTINCT doc_id, word FROM words),
  dfs AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
  held AS (SELECT DISTINCT l.doc_id, lower(l.aspect) AS aspect FROM labelled l JOIN dw ON dw.doc_id = l.doc_id AND dw.word = lower(l.aspect)),
  fa AS (SELECT aspect, count(*) AS n FROM held GROUP BY aspect),
  jt AS (SELECT h.doc_id, h.aspect, b.word FROM held h JOIN dw b USING (doc_id) WHERE b.word <> h.aspect),
  jc AS (SELECT aspect, word, count(*) AS n FROM jt GROUP BY aspect, word),
  dn AS (SELECT count(*)::DOUBLE AS d FROM documents),
  pmi AS (SELECT doc_id, jt.aspect, avg(log2(d * jc.n / (fa.n * fw.n))) AS mi
    FROM jt JOIN jc USING (aspect, word) JOIN dfs fw ON fw.word = jt.word JOIN fa USING (aspect), dn GROUP BY doc_id, jt.aspect)"""


def _own_docs(spark, sf):
    return C.docs(spark, sf).join(C.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    "aspect_pmi_rows",
    f"{OWN_DOCS}{C.SQL_WORDS}, {C.SQL_LABELLED}, {OWN_PMI} SELECT doc_id, aspect, round(mi, 5) AS mutual_information_score FROM pmi",
)
def aspect_pmi_rows(spark, sf):
    rows = C.labelled(spark, sf).select("doc_id", "aspect", F.col("raw_text").alias("text"))
    out = I.aspect_pmi_rows(rows, _own_docs(spark, sf))
    return out.withColumn("mutual_information_score", F.round("mutual_information_score", 5))


SCORED = f"""{OWN_DOCS}{UNIGRAM}, {BIGRAM}, {C.SQL_LABELLED}, {OWN_PMI},
  cc AS (SELECT doc_id, word, count(*) AS k, any_value(n_words) AS n FROM words GROUP BY doc_id, word),
  ent AS (SELECT doc_id, -sum((k::DOUBLE / n) * log2(k::DOUBLE / n)) AS h FROM cc GROUP BY doc_id)
  SELECT l.doc_id::VARCHAR AS "Comment ID", row_number() OVER (ORDER BY l.doc_id, l.aspect) - 1 AS "index", raw_text, l.aspect,
    implicitness, polarity, round(h, 5) + 0.0 AS shannon_entropy, round(mi, 5) AS mutual_information_score,
    round(surprisal, 5) AS surprisal, round(pow(2, surprisal), 2) AS perplexity,
    round(cm, 5) AS contextual_mutual_information_score, round(cs, 5) AS contextual_surprisal,
    round(pow(2, cs), 2) AS contextual_perplexity
  FROM labelled l LEFT JOIN ent USING (doc_id) LEFT JOIN uni USING (doc_id) LEFT JOIN ctx USING (doc_id)
    LEFT JOIN pmi ON pmi.doc_id = l.doc_id AND pmi.aspect = lower(l.aspect)"""


def scored_rows(spark, sf):
    rows = dense_index(C.labelled(spark, sf).drop("token_ids", "aspect_mask"), ["doc_id", "aspect"], "index", wide=True)
    docs = _own_docs(spark, sf).withColumnRenamed("text", "raw_text")
    out = I.scored_table(rows, docs, "doc_id").withColumnRenamed("doc_id", "Comment ID")
    cut = {"perplexity": 2, "contextual_perplexity": 2}
    return I.declared(out).select(
        *[f"`{c}`" for c in I.REVIEW_COLUMNS[:6]],
        *[(F.round(c, cut.get(c, 5)) + 0.0).alias(c) for c in I.METRICS],
    )


@query("scored_table", SCORED)
def scored_table(spark, sf):
    return scored_rows(spark, sf)


@query("review_rows", SCORED + " ORDER BY perplexity DESC")
def review_rows(spark, sf):
    return I.review_rows(scored_rows(spark, sf))


@query("information_metrics", METRICS)
def information_metrics(spark, sf):
    return _rounded(I.information_metrics(C.docs(spark, sf), C.ASPECTS))


@query("review_ranking", METRICS + " ORDER BY perplexity DESC")
def review_ranking(spark, sf):
    metrics = _rounded(I.information_metrics(C.docs(spark, sf), C.ASPECTS))
    return I.review_ranking(metrics, ["doc_id", "aspect"])


@query(
    "review_top",
    METRICS
    + """ ORDER BY perplexity DESC NULLS LAST, surprisal DESC NULLS LAST, mutual_information_score DESC NULLS LAST,
    contextual_perplexity DESC NULLS LAST, contextual_surprisal DESC NULLS LAST,
    contextual_mutual_information_score DESC NULLS LAST, d.doc_id, aspect NULLS FIRST LIMIT 100""",
)
def review_top(spark, sf):
    """Top-k report: the hundred rows to look at first."""
    metrics = _rounded(I.information_metrics(C.docs(spark, sf), C.ASPECTS))
    return I.review_ranking(metrics, ["doc_id", "aspect"], top=100)
