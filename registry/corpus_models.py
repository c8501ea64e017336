"""Queries: word vectors, topics, reduced embeddings.

Their numbers are not SQL's, but what must hold of them is: the ``check_``
queries state it and SQL says what is to come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registry import common as C
from sentiloom.functions import text as X
from sentiloom.operators import models as M
from sentiloom.operators import topics as T
from sentiloom.operators import vectors as V

QUERIES, ORACLE, query = C.registry()
K_NEAREST, K_TOPICS, N_WORDS, K_REDUCED = 10, 5, 5, 3


@query("similar_words")
def similar_words(spark, sf):
    return V.similar_words(V.pmi_vectors(C.docs(spark, sf)), C.CONTEXT_ASPECT, K_NEAREST)


@query("topics")
def topics(spark, sf):
    return M.topics(C.docs(spark, sf), k=K_TOPICS, n_words=N_WORDS)


@query("reduce_embeddings")
def reduce_embeddings(spark, sf):
    out = M.reduce_embeddings(C.table(spark, sf, "embeddings"), k=K_REDUCED)
    return out.select(
        "vec_id", "label", *[F.round(F.col("reduced")[i], 6).alias(f"pc{i + 1}") for i in range(K_REDUCED)]
    )


@query(
    "check_word_vectors",
    f"SELECT unnest(range(1, {K_NEAREST + 1})) AS rank, TRUE AS is_cosine, TRUE AS in_corpus, TRUE AS nothing_nearer",
)
def check_word_vectors(spark, sf):
    """The nearest words of the operator are those of the cosines of its vectors."""
    docs = C.docs(spark, sf)
    found = V.pmi_vectors(docs)
    vectors = found.select("word", F.col("v").cast("array<double>").alias("v"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    target = vectors.where(F.col("word") == C.CONTEXT_ASPECT).agg(F.first("v")).scalar()
    dot = F.aggregate(F.zip_with("v", "t", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    cosines = (
        vectors.where(F.col("word") != C.CONTEXT_ASPECT)
        .withColumn("t", target)
        .select("word", F.try_divide(dot, length(F.col("v")) * length(F.col("t"))).alias("cosine"))
        .where(F.col("cosine").isNotNull())  # a word without direction has none
    )
    best = cosines.orderBy(F.desc("cosine")).limit(K_NEAREST)
    least = best.agg(F.min("cosine")).scalar()
    corpus = docs.select(F.explode(X.words("text")).alias("word")).distinct().withColumn("known", F.lit(True))
    ranked = V.similar_words(found, C.CONTEXT_ASPECT, K_NEAREST).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "word")).cast("bigint")
    )
    return (
        ranked.join(cosines, "word", "left")
        .join(corpus, "word", "left")
        .select(
            "rank",
            (F.abs(F.col("similarity") - F.col("cosine")) < 1e-4).alias("is_cosine"),
            F.coalesce("known", F.lit(False)).alias("in_corpus"),
            (F.col("cosine") > least - 1e-4).alias("nothing_nearer"),
        )
    )


@query(
    "check_topics",
    f"""SELECT t.topic::INTEGER AS topic, r.rank::INTEGER AS rank, TRUE AS descending, TRUE AS in_corpus
    FROM range({K_TOPICS}) t(topic), range({N_WORDS}) r(rank)""",
)
def check_topics(spark, sf):
    """As many words for each topic as asked for, by weight, all from the texts."""
    docs = C.docs(spark, sf)
    corpus = docs.select(F.explode(X.alphanumerics("text")).alias("word")).distinct().withColumn("known", F.lit(True))
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    rows = M.topics(docs, k=K_TOPICS, n_words=N_WORDS).withColumn(
        "descending", F.coalesce(before >= F.col("weight"), F.lit(True))
    )
    return rows.join(corpus, "word", "left").select(
        "topic", "rank", "descending", F.coalesce("known", F.lit(False)).alias("in_corpus")
    )


@query(
    "check_reduced",
    "SELECT count(*) AS n, TRUE AS centred, TRUE AS uncorrelated, TRUE AS by_variance, TRUE AS within_input FROM embeddings",
)
def check_reduced(spark, sf):
    """Means are zero, components uncorrelated, by variance, and hold no more of it than there is."""
    table = C.table(spark, sf, "embeddings")
    size = F.size("embedding")
    entries = table.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    total = entries.groupBy("i").agg(F.var_samp("x").alias("v")).agg(F.sum("v")).scalar()
    out = M.reduce_embeddings(table.where(size > 0), k=K_REDUCED).select(*[F.col("reduced")[i].alias(f"p{i}") for i in range(K_REDUCED)])
    names = out.columns
    small = lambda c: F.abs(c) < 1e-6
    pairs = [(a, b) for a in names for b in names if a < b]
    variances = [F.var_samp(c) for c in names]
    every = lambda conditions: F.least(*conditions) if len(conditions) > 1 else conditions[0]
    return out.agg(
        F.count("*").alias("n"),
        every([small(F.avg(c)) for c in names]).alias("centred"),
        every([small(F.corr(a, b)) for a, b in pairs]).alias("uncorrelated"),
        every([variances[i] >= variances[i + 1] for i in range(len(names) - 1)]).alias("by_variance"),
        (sum(variances[1:], variances[0]) <= total + 1e-9).alias("within_input"),
    )


@query("nearest_words")
def nearest_words(spark, sf):
    """Nearest words of the whole lexicon, by vectors of stored pair counts."""
    vectors = V.pmi_vectors(C.docs(spark, sf))
    return V.nearest_words(vectors, C.lexicon(spark).select("word"), K_NEAREST)


@query(
    "check_nearest_words",
    f"""SELECT word, TRUE AS twin_found FROM (VALUES {", ".join(f"('{a}')" for a in C.ASPECTS)}) t(word)
    WHERE EXISTS (SELECT 1 FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}])' || word || '($|[^\\p{{L}}])'))""",
)
def check_nearest_words(spark, sf):
    """A twin, put in a word's place in a second copy of all texts, is among its nearest words."""
    docs = C.docs(spark, sf)
    pattern = rf"(?i)(?<!\p{{L}})({'|'.join(C.ASPECTS)})(?!\p{{L}})"
    twins = docs.withColumn("text", F.regexp_replace("text", pattern, "$1twin"))
    vectors = V.pmi_vectors(docs.unionByName(twins))
    aspects = spark.createDataFrame([(a,) for a in C.ASPECTS], "word string")
    twin = (F.col("word") == F.concat("target", F.lit("twin"))) & (F.col("cosine") > 0.8)
    nearest = V.nearest_words(vectors, aspects, K_NEAREST)
    return nearest.groupBy(F.col("target").alias("word")).agg(F.bool_or(twin).alias("twin_found"))


@query("corpus_topics")
def corpus_topics(spark, sf):
    """The words of each topic, by a model that holds no vocabulary in one place."""
    return T.top_words(T.corpus_topics(C.docs(spark, sf), k=K_TOPICS).words, N_WORDS)


@query("document_topics")
def document_topics(spark, sf):
    """A row for each topic of a document; one with a NULL topic where no content word is."""
    shares = T.corpus_topics(C.docs(spark, sf), k=K_TOPICS).documents
    return shares.select("doc_id", F.posexplode_outer("topics").alias("topic", "share"))


@query(
    "check_planted_topics",
    f"""SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(text), '(\\p{{L}}+)')) > 0 THEN TRUE END AS separated
    FROM documents""",
)
def check_planted_topics(spark, sf):
    """Even and odd documents get words of their own beside shared ones; two topics tell them apart."""
    own = F.pmod("doc_id", F.lit(2))
    letter = F.when(own == 0, "even").otherwise("odd")
    place = lambda i: F.pmod(i * 7 + F.col("doc_id"), F.lit(20)).cast("string")
    planted = F.transform(
        X.words("text"), lambda _, i: F.when(i % 3 == 2, F.concat(F.lit("shared"), place(i))).otherwise(F.concat(letter, place(i)))
    )
    docs = C.docs(spark, sf).withColumn("text", F.array_join(planted, " "))
    topics = T.corpus_topics(docs, k=2).documents.withColumn("own", own)
    mean = lambda parity: F.avg(F.when(F.col("own") == parity, F.col("topics")[0]))
    first = topics.agg((mean(0) > mean(1)).alias("even_is_first")).scalar()
    is_even = (F.col("topics")[0] > 0.5) == first
    return topics.select("doc_id", F.when(F.col("topics").isNotNull(), is_even == (F.col("own") == 0)).alias("separated"))
