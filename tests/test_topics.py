"""Topics against a dense model of the same steps, planted ones, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry import QUERIES
from sentiloom.operators import models as M
from sentiloom.operators import topics as T

SF = "/root/testdata/sf0.001"
WORDS = "camera lens photo battery charge power screen pixel colour case".split()


def corpus(spark, n=60):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[:6] if i % 2 else WORDS[4:], rng.integers(1, 40)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id int, text string").repartition(4)


def dense(rows, names, start, k, rounds, passes, alpha, eta):
    at = {w: i for i, w in enumerate(names)}
    n = np.zeros((len(rows), len(names)))
    for d, (_, text) in enumerate(rows):
        for w in text.split():
            n[d, at[w]] += 1

    def solve(weights):
        p = (weights + eta) / (weights.sum(axis=0) + eta * len(names))
        shares = np.full((len(rows), k), 1 / k)
        for _ in range(passes):
            taken = p[None] * shares[:, None, :]
            taken *= (n / taken.sum(axis=2))[:, :, None]
            shares = taken.sum(axis=1) + alpha
            shares /= shares.sum(axis=1, keepdims=True)
        return shares, taken.sum(axis=0)

    weights = start
    for _ in range(rounds):
        weights = solve(weights)[1]
    return weights, solve(weights)[0]


@pytest.mark.parametrize("block", [T.ENTRIES, 40])
def test_equals_the_dense_model(spark, monkeypatch, block):
    monkeypatch.setattr(T, "PIECE", 7)
    monkeypatch.setattr(T, "STEP", 11)
    rows, docs = corpus(spark)
    got = T.corpus_topics(docs, k=3, rounds=4, block=block)
    names = sorted({w for _, text in rows for w in text.split()})
    counts = {w: sum(text.split().count(w) for _, text in rows) for w in names}
    ids = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("id", F.xxhash64("word", F.lit(42)))
    drawn = {r["id"]: [r["s0"], r["s1"], r["s2"]] for r in T.start_weights(ids, 3, 42).collect()}
    start = np.array([drawn[r["id"]] for r in ids.orderBy("word").collect()])
    np.testing.assert_allclose(start.sum(axis=1), [counts[w] for w in names])
    weights, shares = dense(rows, names, start, 3, 4, 5, 0.1, 0.01)
    words = {r["word"]: r["weights"] for r in got.words.collect()}
    np.testing.assert_allclose(np.array([words[w] for w in names]), weights, rtol=1e-6, atol=1e-9)
    documents = {r["doc_id"]: r["topics"] for r in got.documents.collect()}
    np.testing.assert_allclose(np.array([documents[i] for i, _ in rows]), shares, rtol=1e-6, atol=1e-9)
    top = T.top_words(got.words, 4).orderBy("topic", "rank").collect()
    for t in range(3):
        best = sorted(names, key=lambda w: (-words[w][t], w))[:4]
        assert [r["word"] for r in top if r["topic"] == t] == best


def test_planted_topics_are_told_apart_and_a_wrong_model_is_not(spark):
    assert QUERIES["check_planted_topics"](spark, SF).where("not coalesce(separated, true)").isEmpty()
    rows, docs = corpus(spark, 200)
    blind = T.corpus_topics(docs, k=2, rounds=0, passes=1).documents
    assert blind.where("(topics[0] > 0.5) = (doc_id % 2 = 0)").count() not in (0, 200)


def test_rows_without_words_ties_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, "the of"), (None, "camera lens"), (4, "camera lens"), (4, "camera lens"), (5, "x" * 5000), (6, "camera " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("topics", F.lit("clash"))
    got = T.corpus_topics(docs, k=2, rounds=2)
    found = got.documents.collect()
    assert len(found) == len(rows)
    assert {r["doc_id"] for r in found if r["topics"] is None} == {1, 2, 3}
    assert all(sum(r["topics"]) == pytest.approx(1) for r in found if r["topics"])
    weights = {r["word"]: sum(r["weights"]) for r in got.words.collect()}
    assert weights == {"camera": pytest.approx(30003), "lens": pytest.approx(3), "x" * 5000: pytest.approx(1)}
    often = T.corpus_topics(docs, k=2, rounds=2, min_df=2)
    assert {r["word"] for r in often.words.collect()} == {"camera", "lens"}
    assert often.documents.where("topics is null").count() == 4


def test_no_documents(spark):
    got = T.corpus_topics(spark.createDataFrame([], "doc_id int, text string"), k=2, rounds=2)
    assert got.words.isEmpty() and got.documents.isEmpty() and T.top_words(got.words).isEmpty()


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_documents_move_once(spark, blocks):
    """A round meets blocks where they were stored, each in a bucket of its own; only words are shuffled."""
    labels = T._labels(spark, blocks)
    places = spark.createDataFrame([(i,) for i in labels], "i int").select(F.pmod(F.hash("i"), F.lit(blocks)))
    assert sorted(r[0] for r in places.collect()) == list(range(blocks))
    content = T._content(corpus(spark)[1], "doc_id", "text", [])
    words, seed = T._lexicon(content, 1, 42)
    pieces = T._pieces(content, words, blocks, seed, 1)
    chances = words.select(F.lit(labels[0]).alias("block"), "id", F.lit(0.1).alias("p0"))
    plan = T._pass(pieces, chances, 1, 0.1, 1, False)._jdf.queryExecution().executedPlan().toString()
    entries = plan[plan.index("FlatMapCoGroups") :].split("Sort [block")[1]
    assert "topic_entries" in entries and "Exchange" not in entries


def test_the_query_holds_no_vocabulary_in_the_driver(spark):
    rows, docs = corpus(spark)
    want = T.top_words(T.corpus_topics(docs, k=2, rounds=3).words, 3)
    assert sorted(map(tuple, M.topics(docs, k=2, n_words=3, iterations=3).collect())) == sorted(map(tuple, want.collect()))
    assert not hasattr(M, "CountVectorizer")
