"""Vocabulary counts and information metrics of a corpus.

Words are lower-cased runs of letters, logarithms have base 2.  Counts are
exact.  Per-row metrics look up corpus counts through
:func:`sentiloom.operators.scale.frequency_join`.  A ``docs`` table has one
row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom.functions import text as X
from sentiloom.operators.scale import dense_index, frequency_join, stored
from sentiloom.schemas import METRICS, SCORED


def bow(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bag of words ``(key, word, n)``, counted inside each row."""
    return docs.select(key, F.explode(X.word_counts(X.words(text))).alias("_c")).select(
        key, F.col("_c.word").alias("word"), F.col("_c.k").cast("bigint").alias("n")
    )


def word_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n, df)``: corpus count and document frequency, one shuffle.

    A row gives all its words and, once more, its different ones; nothing is
    sorted or counted inside it.
    """
    part = lambda ws, n, df: F.struct(
        ws.alias("_ws"), F.lit(n).cast("bigint").alias("n"), F.lit(df).cast("bigint").alias("df")
    )
    parts = X.let(X.words(text), lambda ws: F.array(part(ws, 1, 0), part(F.array_distinct(ws), 0, 1)))
    rows = docs.select(F.inline(parts)).select(F.explode("_ws").alias("word"), "n", "df")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Dictionary ``(word, n, df, id)`` with dense ids in word order."""
    return dense_index(word_statistics(docs, key, text), ["word"], "id")


def _pair_rows(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    rows = docs.select(*keys, X.words(text).alias("_ws")).select(
        *keys, F.explode(X.adjacent_pairs("_ws")).alias("_p")
    )
    return rows.select(*keys, F.col("_p.v").alias("v"), F.col("_p.w").alias("w")).where(
        F.col("v").isNotNull() & F.col("w").isNotNull()
    )


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over the corpus.

    The filter spells out what joins on the word ask for, so that every use
    of the counts in one plan has the same shuffle and shares it.
    """
    return (
        docs.select(F.explode(X.words(text)).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(v, w, n)``: how often ``w`` follows ``v`` within a row."""
    return (
        _pair_rows(docs, text)
        .groupBy("v", "w")
        .agg(F.count("*").alias("n"))
    )


def entropy(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shannon entropy of each row's word distribution; no shuffle."""
    return docs.select(key, X.entropy(X.words(text)).alias("shannon_entropy"))


def unigram_lm(
    docs: DataFrame, key: str = "doc_id", text: str = "text", counts: DataFrame | None = None
) -> DataFrame:
    """Mean −log2 p(word) under the corpus' own word counts, and 2 to it."""
    counts = stored(word_counts(docs, text), "word-counts") if counts is None else counts
    total = counts.agg(F.sum("n")).scalar()
    rows = docs.select(key, F.explode(X.words(text)).alias("word"))
    bits = F.avg(F.log2(F.col("n").cast("double")))
    return (
        frequency_join(rows, counts, ["word"])
        .groupBy(key)
        .agg((F.log2(total.cast("double")) - bits).alias("surprisal"))
        .withColumn("perplexity", F.pow(F.lit(2.0), F.col("surprisal")))
    )


# Sums of logs that all unigram and pair metrics consist of.
SUMS = ("tokens", "pairs", "uni", "start", "smooth", "end", "pair", "smooth_pair")


def _part(df: DataFrame, key: str, **columns: Column) -> DataFrame:
    """One contribution to the sums; what it does not name is 0."""
    return df.select(
        key, *[columns.get(c, F.lit(0.0)).cast("double").alias(c) for c in (*SUMS, "entropy")]
    )


def _seed(words: DataFrame) -> int:
    """A seed whose hashes tell all words apart."""
    seed = 42
    while not words.groupBy(F.xxhash64("word", F.lit(seed))).count().where("count > 1").isEmpty():
        seed += 1
    return seed


def _coded(docs: DataFrame, key: str, text: str, words: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """Texts as arrays of hashes ``(key, ids)``, the count of each ``(id, n)``, both stored, and the seed.

    The hashes tell all words apart.  Where no counts are given, a second hash
    beside the first one shows whether two words share it.
    """
    if words is not None:
        seed = _seed(words)
        coded = stored(docs.select(key, X.hashes(X.words(text), seed).alias("ids")), "word-hashes")
        return coded, words.select(F.xxhash64("word", F.lit(seed)).alias("id"), "n"), seed
    seed = 42
    while True:
        both = X.let(X.words(text), lambda ws: F.struct(X.hashes(ws, seed).alias("ids"), X.hashes(ws, ~seed).alias("other")))
        coded = stored(docs.select(key, both.alias("_h")).select(key, "_h.*"), "word-hashes")
        rows = coded.select(F.inline(F.arrays_zip("ids", "other")))
        counts = rows.groupBy(F.col("ids").alias("id")).agg(
            F.count("*").alias("n"), (F.min("other") != F.max("other")).alias("shared")
        )
        counts = stored(counts, "word-counts")
        if counts.where("shared").isEmpty():
            return coded.drop("other"), counts.drop("shared"), seed
        seed += 1


def _id_rows(coded: DataFrame, key: str) -> DataFrame:
    """Words with what they count for: themselves, pair starts, pair ends."""
    rows = coded.select(key, F.array_size("ids").alias("_m"), F.posexplode("ids").alias("_pos", "id"))
    return rows.select(key, "id", (F.col("_pos") + 1 < F.col("_m")).alias("starts"), (F.col("_pos") > 0).alias("ends"))


def _id_pairs(coded: DataFrame, *keys: str) -> DataFrame:
    return coded.select(*keys, F.inline(X.adjacent_pairs("ids")))


def _language_sums(
    coded: DataFrame, counts: DataFrame, seed: int, key: str, pairs: DataFrame | None, with_entropy: bool = False
) -> tuple[DataFrame, Column, Column]:
    """Sums per row, and how many words and pairs the corpus has.

    Words and pairs, which are counted if that was not done before, are looked
    up by the hashes that :func:`_coded` makes.  Pairs seen
    once are neither kept nor looked up: a row adds 1 for each of its pairs
    (log2 of its count and one), and what a more frequent one adds to that.
    ``with_entropy`` adds the row's own entropy, and rows without any word.
    """
    named = lambda c: F.xxhash64(c, F.lit(seed)).alias(c)
    row_pairs = F.greatest(F.array_size("ids") - 1, F.lit(0))
    if pairs is None:
        counted = _id_pairs(coded).groupBy("v", "w").agg(F.count("*").alias("n"))
        counted = stored(counted.where("n > 1"), "pair-counts")
        n_pairs = coded.agg(F.sum(row_pairs)).scalar()
    else:
        counted = pairs.select(named("v"), named("w"), "n")
        n_pairs = pairs.agg(F.sum("n")).scalar()
    size = counts.agg(F.count("*")).scalar()
    n_words = counts.agg(F.sum("n")).scalar()
    n = F.col("n").cast("double")
    starts = F.col("starts").cast("double")
    by_word = _part(
        frequency_join(_id_rows(coded, key), counts, ["id"]),
        key,
        uni=F.log2(n),
        start=starts * F.log2(n),
        smooth=starts * F.log2(n + size),
        end=F.col("ends").cast("double") * F.log2(n),
    )
    by_pair = _part(
        frequency_join(_id_pairs(coded, key), counted, ["v", "w"], once=False),
        key,
        pair=F.log2(n),
        smooth_pair=F.log2(n + 1) - 1,
    )
    own = coded if with_entropy else coded.where(F.array_size("ids") > 0)
    by_row = _part(
        own,
        key,
        tokens=F.coalesce(F.array_size("ids"), F.lit(0)),
        pairs=F.coalesce(row_pairs, F.lit(0)),
        smooth_pair=F.coalesce(row_pairs, F.lit(0)),
        **({"entropy": X.entropy(F.col("ids"))} if with_entropy else {}),
    )
    sums = by_word.unionByName(by_pair).unionByName(by_row).groupBy(key).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum("entropy").alias("shannon_entropy")
    )
    return sums, n_words, n_pairs


def _contextual(n_words: Column, n_pairs: Column) -> list[Column]:
    n, p = n_words.cast("double"), n_pairs.cast("double")
    m = F.col("pairs")
    some = m > 0
    bits = (F.col("smooth") - F.col("smooth_pair")) / m
    info = (F.col("pair") - F.col("start") - F.col("end")) / m + 2 * F.log2(n) - F.log2(p)
    return [
        F.when(some, info).alias("contextual_mutual_information_score"),
        F.when(some, bits).alias("contextual_surprisal"),
        F.when(some, F.pow(F.lit(2.0), bits)).alias("contextual_perplexity"),
    ]


def bigram_lm(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Surprisal given the previous word (add-one), perplexity, pair PMI.

    Rows with a single word have no pair: their metrics are NULL.
    """
    sums, n_words, n_pairs = _language_sums(*_coded(docs, key, text, words), key, pairs)
    return sums.select(key, *_contextual(n_words, n_pairs))


def _document_words(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(word, _df)``: in how many rows a word occurs."""
    words = docs.select(F.explode(F.array_distinct(tokens)).alias("word")).where(F.col("word").isNotNull())
    return words.groupBy("word").agg(F.count("*").alias("_df"))


def _pmi(held: DataFrame, docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Mean PMI by (key, aspect) from rows ``(key, aspect, _others)`` that hold their aspect.

    ``tokens`` are the words of ``docs``, or hashes that tell them apart.

    The words beside each held aspect are stored once, as are the document
    counts: the texts are read twice.  The score is made once per distinct
    (aspect, word) and then looked up.
    """
    joint = stored(held.select(key, "aspect", F.explode_outer("_others").alias("word")), "aspect-words")
    frequency = stored(_document_words(docs, tokens), "document-counts")
    n_docs = docs.agg(F.count("*")).scalar().cast("double")
    own = joint.groupBy("aspect").agg(F.countDistinct(key).alias("_own"))
    words = joint.where(F.col("word").isNotNull())
    met = words.groupBy("aspect", "word").agg(F.count("*").alias("n"))
    odds = n_docs * F.col("n") / (F.col("_own").cast("double") * F.col("_df"))
    scores = stored(
        met.join(frequency, "word").join(own, "aspect").select("aspect", "word", "n", F.log2(odds).alias("pmi")), "aspect-scores"
    )
    return (
        frequency_join(words, scores, ["aspect", "word"])
        .groupBy(key, "aspect")
        .agg(F.avg("pmi").alias("mutual_information_score"))
    )


def aspect_pmi(
    docs: DataFrame, aspects: Sequence[str], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Mean pointwise mutual information of an aspect word with the row's words.

    Only rows that hold an aspect of the list are paired, and only with it.
    """
    return _listed_pmi(docs, aspects, key, X.words(text), F.lit)


def _listed_pmi(
    docs: DataFrame, aspects: Sequence[str], key: str, tokens: Column, token: Callable[[str], Column]
) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(t).alias("aspect"), token(t).alias("token")) for t in dict.fromkeys(aspects)])

    def meetings(ws: Column) -> Column:
        return F.transform(
            F.filter(listed, lambda a: F.array_contains(ws, a["token"])),
            lambda a: F.struct(a["aspect"].alias("aspect"), F.array_remove(ws, a["token"]).alias("_others")),
        )

    held = docs.select(key, F.inline(X.let(F.array_distinct(tokens), meetings)))
    return _pmi(held, docs, key, tokens)


def aspect_pmi_rows(
    rows: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", aspect: str = "aspect"
) -> DataFrame:
    """The same for rows ``(key, aspect, text)`` that bring their own aspect.

    ``docs`` is the corpus, a row per key, that words are counted in.  A row
    whose aspect is no word of its text has no score; rows are one (key,
    aspect) each.
    """
    words = rows.select(key, F.lower(aspect).alias("aspect"), F.array_distinct(X.words(text)).alias("_ws"))
    held = words.where(F.array_contains("_ws", F.col("aspect"))).select(
        key, "aspect", F.array_remove("_ws", F.col("aspect")).alias("_others")
    )
    return _pmi(held.dropDuplicates([key, "aspect"]), docs, key, X.words(text))


def _corpus_metrics(coded: DataFrame, counts: DataFrame, seed: int, key: str, pairs: DataFrame | None) -> DataFrame:
    """The six metrics that do not ask for an aspect, one row per key."""
    sums, n_words, n_pairs = _language_sums(coded, counts, seed, key, pairs, with_entropy=True)
    total = n_words.cast("double")
    some = F.col("tokens") > 0
    bits = F.when(some, F.log2(total) - F.col("uni") / F.col("tokens"))
    return sums.select(
        key,
        F.when(some, F.col("shannon_entropy")).alias("shannon_entropy"),
        bits.alias("surprisal"),
        F.pow(F.lit(2.0), bits).alias("perplexity"),
        *_contextual(n_words, n_pairs),
    )


def information_metrics(
    docs: DataFrame,
    aspects: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    words: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """All seven metrics, one row per (row, aspect); aspect NULL where none occurs.

    ``words`` and ``pairs`` may be stored results of :func:`word_counts` and
    :func:`pair_counts`, so that a large corpus is counted once.
    """
    coded, counts, seed = _coded(docs, key, text, words)
    corpus = _corpus_metrics(coded, counts, seed, key, pairs)
    pmi = _listed_pmi(coded, aspects, key, F.col("ids"), lambda t: F.xxhash64(F.lit(t), F.lit(seed)))
    return corpus.join(pmi, key, "left").select(key, "aspect", *METRICS)


def scored_table(
    rows: DataFrame,
    docs: DataFrame,
    key: str,
    text: str = "raw_text",
    aspect: str = "aspect",
    words: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Labelled rows with their seven metrics; the row's own aspect counts.

    ``docs`` has a row per key with the same text column; metrics of a text
    are made once and joined to each of its rows.
    """
    corpus = _corpus_metrics(*_coded(docs, key, text, words), key, pairs)
    pmi = aspect_pmi_rows(rows.select(key, aspect, text), docs, key, text, aspect).withColumnRenamed("aspect", "_aspect")
    out = rows.withColumn("_aspect", F.lower(aspect)).join(corpus, key, "left").join(pmi, [key, "_aspect"], "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *METRICS)


def declared(df: DataFrame, schema: T.StructType = SCORED) -> DataFrame:
    """The declared columns of a scored table, by name; what is absent is NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


# Sort columns of the review ranking, most important first.
RANKING = (
    "perplexity",
    "surprisal",
    "mutual_information_score",
    "contextual_perplexity",
    "contextual_surprisal",
    "contextual_mutual_information_score",
)


# What the ranking shows of a scored row, in this order.
REVIEW_COLUMNS = (
    "Comment ID",
    "index",
    "raw_text",
    "aspect",
    "implicitness",
    "polarity",
    "shannon_entropy",
    "mutual_information_score",
    "surprisal",
    "perplexity",
    "contextual_mutual_information_score",
    "contextual_surprisal",
    "contextual_perplexity",
)


def review_rows(scored: DataFrame, top: int | None = None) -> DataFrame:
    """The thirteen columns of a scored table, ranked."""
    return review_ranking(scored.select(*[F.col(f"`{c}`") for c in REVIEW_COLUMNS]), ["`Comment ID`", "index", "aspect"], top)


def review_ranking(df: DataFrame, keys: Sequence[str], top: int | None = None) -> DataFrame:
    """Rows by decreasing metrics, ties by key; ``top`` turns it into a report."""
    ranked = df.orderBy(
        *[F.col(c).desc_nulls_last() for c in RANKING], *[F.col(k).asc() for k in keys]
    )
    return ranked if top is None else ranked.limit(top)
