"""Metrics that look words up by their hashes."""

from pyspark.sql import functions as F

from sentiloom.functions import text as X
from sentiloom.operators import information as I

TEXTS = [(1, "a b a b c"), (2, "b a"), (3, "c"), (4, ""), (5, None), (6, "A b a B d é")]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.na.fill(-1).collect())


def test_texts_are_cut_into_words_once(spark):
    for df in (I.bigram_lm(_docs(spark)), I.information_metrics(_docs(spark), ["a", "é"])):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    want = _rows(I.bigram_lm(_docs(spark)))
    plain = X.hashes
    same = lambda tokens, seed: F.transform(tokens, lambda w: F.length(w).cast("long")) if seed == 42 else plain(tokens, seed)
    monkeypatch.setattr(X, "hashes", same)
    assert _rows(I.bigram_lm(_docs(spark))) == want
    assert {r[0] for r in want} == {1, 2, 3, 6}


def test_counts_given_or_made_give_the_same(spark):
    docs = _docs(spark)
    given = {"words": I.word_counts(docs), "pairs": I.pair_counts(docs)}
    for make in (I.bigram_lm, lambda d, **c: I.information_metrics(d, ["a", "é"], **c).fillna("-", ["aspect"])):
        want = _rows(make(docs))
        assert want and _rows(make(docs, **given)) == want
        assert _rows(make(docs, words=given["words"])) == _rows(make(docs, pairs=given["pairs"])) == want
