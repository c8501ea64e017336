"""Models against their definitions on small data; the inference hook."""

from uuid import uuid4

import numpy as np
import pytest

from sentiloom.operators import models as M
from sentiloom.operators.infer import infer, infer_stored, stored_answers


def test_pca_equals_svd_up_to_sign(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "vec_id int, embedding array<float>")
    got = np.array([r["reduced"] for r in M.reduce_embeddings(df).orderBy("vec_id").collect()])
    centred = data - data.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:3].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-4)


def test_similar_words_are_nearest_by_cosine(spark):
    docs = spark.createDataFrame([(0, "the camera is good. the screen is good. a camera and a screen. bad food.")], "doc_id int, text string")
    model = M.word_vectors(docs, size=8, partitions=1)
    vectors = {r["word"]: np.array(r["vector"].toArray()) for r in model.getVectors().collect()}
    target = vectors.pop("camera")
    cosine = {w: float(v @ target / np.linalg.norm(v) / np.linalg.norm(target)) for w, v in vectors.items()}
    got = {r["word"]: r["similarity"] for r in M.similar_words(model, "camera", 3).collect()}
    assert set(got) == set(sorted(cosine, key=cosine.get, reverse=True)[:3])
    for word, value in got.items():
        assert value == pytest.approx(cosine[word], abs=1e-4)


def test_topics_rank_by_weight_without_stop_words(spark):
    texts = ["the camera camera lens photo", "the battery charge battery power"] * 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = M.topics(docs, k=2, n_words=3, iterations=5).orderBy("topic", "rank").collect()
    assert len(rows) == 6 and "the" not in {r["word"] for r in rows}
    for topic in (0, 1):
        weights = [r["weight"] for r in rows if r["topic"] == topic]
        assert weights == sorted(weights, reverse=True)


def test_topics_know_numbers(spark):
    docs = spark.createDataFrame([(i, "model 4000 camera") for i in range(8)], "doc_id int, text string")
    assert "4000" in {r["word"] for r in M.topics(docs, k=2, n_words=3, iterations=2).collect()}


def test_infer_keeps_keys_and_checks_length(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "k int, prompt string").repartition(3)
    got = infer(prompts, lambda batch: [p.upper() for p in batch], "k").collect()
    assert sorted((r["k"], r["answer"]) for r in got) == [(i, f"P{i}") for i in range(50)]
    with pytest.raises(Exception, match="prompts but"):
        infer(prompts, lambda batch: batch[:-1], "k").collect()


def test_prompts_are_asked_once_over_runs(spark, tmp_path):
    path, log = str(tmp_path / "answers"), tmp_path / "asked"
    log.mkdir()

    def build():
        def ask(batch):
            (log / uuid4().hex).write_text("\n".join(batch))
            return [None if p == "p7" else p.upper() for p in batch]

        return ask

    asked = lambda: sorted(p for f in log.iterdir() for p in f.read_text().split("\n"))
    rows = [(i, f"p{i % 20}") for i in range(100)] + [(100, None), (None, "p3")]
    schema = "k int, prompt string"
    few = spark.createDataFrame(rows[:10], schema)
    infer_stored(few, build, "k", path, "m", parts=3)
    assert asked() == sorted(f"p{i}" for i in range(10))
    many = spark.createDataFrame(rows, schema).repartition(5)
    for parts in (1, 4):
        got = infer_stored(many, build, "k", path, "m", parts=parts).collect()
        want = [(k, None if p in (None, "p7") else p.upper()) for k, p in rows]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert asked() == sorted(f"p{i}" for i in range(20))
    infer_stored(few, build, "k", path, "another/model")
    assert len(asked()) == 30 and stored_answers(spark, path, "m").count() == 20
    with pytest.raises(Exception, match="prompts but"):
        infer_stored(few, lambda: lambda batch: batch[:-1], "k", path, "short")
    assert stored_answers(spark, path, "short").count() == 0
