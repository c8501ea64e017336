"""Word vectors from stored counts: against numpy, planted twins, recall."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from registry import QUERIES
from sentiloom.operators import models as M
from sentiloom.operators import vectors as V

TEXTS = ["the cat sat on the mat", "the dog sat on the rug. a cat saw a dog", "on a mat sat a dog", None, "", "alone"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def plain_counts(texts, window):
    near = Counter()
    for text in texts:
        for line in (text or "").split("."):
            words = line.split()
            for i, v in enumerate(words):
                for w in words[i + 1 : i + 1 + window]:
                    near[v, w] += 1
                    near[w, v] += 1
    return near


def plain_pmi(near):
    total, sums = sum(near.values()), Counter()
    for (v, _), n in near.items():
        sums[v] += n
    return {p: x for p, n in near.items() if (x := math.log(n * total / (sums[p[0]] * sums[p[1]]))) > 0}


def test_products_of_vectors_are_the_best_low_rank_matrix(spark):
    x = plain_pmi(plain_counts(TEXTS, 3))
    words = sorted({v for p in plain_counts(TEXTS, 3) for v in p})
    matrix = np.array([[x.get((v, w), 0.0) for w in words] for v in words])
    values, axes = np.linalg.eigh(matrix)
    first = np.argsort(-abs(values))[:4]
    want = (axes[:, first] * abs(values[first])) @ axes[:, first].T
    rows = {r["word"]: np.array(r["v"]) for r in V.pmi_vectors(frame(spark, TEXTS), size=4, window=3).collect()}
    assert sorted(rows) == words  # "alone" stands near nothing
    got = np.array([rows[w] for w in words])
    np.testing.assert_allclose(got @ got.T, want, atol=1e-4)


def test_many_blocks_equal_one(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(12)) for _ in range(60)]
    one = {r["word"]: np.array(r["v"]) for r in V.pmi_vectors(frame(spark, texts), size=80).collect()}
    many = {r["word"]: np.array(r["v"]) for r in V.pmi_vectors(frame(spark, texts), size=80, block_rows=3).collect()}
    names = sorted(one)
    assert sorted(many) == names
    a, b = (np.array([t[n] for n in names]) for t in (one, many))
    np.testing.assert_allclose(a @ a.T, b @ b.T, atol=1e-3)


def test_a_planted_twin_is_the_nearest_word(spark):
    rng = random.Random(2)
    letters = "bcdfghjklm"
    beside = {t: [t + a + b for a in "aeiou" for b in "xyz"] for t in letters}
    texts = [
        " ".join([*rng.sample(beside[t], 5), t + "a", *rng.sample(beside[t], 4), rng.choice("aeiou")])
        for t in letters
        for _ in range(30)
    ]
    texts += [t.replace("ba ", "twin ") for t in texts]
    vectors = V.pmi_vectors(frame(spark, texts), size=20)
    row = V.nearest_words(vectors, spark.createDataFrame([("ba",), ("ba",), ("gone",), (None,)], "word string"), 1).collect()
    assert [(r["target"], r["rank"], r["word"]) for r in row] == [("ba", 1, "twin")]
    assert row[0]["cosine"] > 0.95
    assert V.similar_words(vectors, "ba", 1).first()["word"] == "twin"
    assert V.similar_words(vectors, "gone", 1).collect() == []


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_recall_of_cells(spark, spread):
    """Against all words, for clustered vectors and for ones that point everywhere."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 24))
    data = centres[rng.integers(0, 200, 4000)] * (1 - spread) + rng.standard_normal((4000, 24)) * spread
    rows = [(f"w{i}", 1, v.tolist()) for i, v in enumerate(data)]
    vectors = spark.createDataFrame([*rows, ("zero", 1, [0.0] * 24)], "word string, n long, v array<float>")
    asked = [f"w{i}" for i in range(0, 4000, 50)]
    out = V.nearest_words(vectors, spark.createDataFrame([(w,) for w in asked], "word string"), 10).collect()
    got = {(r["target"], r["word"]) for r in out}
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    cosines = unit[::50] @ unit.T
    found = 0
    for i, row in enumerate(cosines):
        row[i * 50] = -2
        found += sum((asked[i], f"w{j}") in got for j in np.argsort(-row)[:10])
    assert found / (len(asked) * 10) >= 0.9
    assert all(r["word"] not in (r["target"], "zero") for r in out)


def test_no_text_gives_no_vectors(spark):
    for texts in ([], [None, ""], ["alone", "alone"]):
        vectors = V.pmi_vectors(frame(spark, texts), size=3)
        assert vectors.columns == ["word", "n", "v"]
        assert vectors.collect() == []
        assert V.nearest_words(vectors, spark.createDataFrame([("alone",)], "word string")).collect() == []


def test_rare_words_and_a_high_shift(spark):
    docs = frame(spark, TEXTS)
    kept = {r["word"] for r in V.pmi_vectors(docs, size=3, min_count=3).collect()}
    assert kept == {"the", "sat", "on", "a", "dog"}
    flat = V.pmi_vectors(docs, size=3, shift=1e9).collect()
    assert {tuple(r["v"]) for r in flat} == {(0.0, 0.0, 0.0)}


def test_queries_hold_no_vocabulary_in_the_driver(spark, monkeypatch):
    def held(*args, **kwargs):
        raise AssertionError("a vocabulary in the driver")

    monkeypatch.setattr(M, "Word2Vec", held)
    nearest = QUERIES["similar_words"](spark, "/root/testdata/sf0.001").collect()
    assert len(nearest) == 10
    rows = QUERIES["check_word_vectors"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 11))
    assert all(r["is_cosine"] and r["in_corpus"] and r["nothing_nearer"] for r in rows)


def test_a_product_sends_only_columns_that_a_group_has(spark):
    """Against the dense product; words 30 to 39 have no entries, so their group sends and gets nothing."""
    rng = np.random.default_rng(5)
    dense = np.zeros((40, 40), np.float32)
    for v, w in rng.integers(0, 30, (60, 2)):
        dense[v, w] = dense[w, v] = 1 + v + w
    rows = [(int(v), int(w), float(dense[v, w])) for v, w in zip(*np.nonzero(dense))]
    cells = V.Cells(40, 4, 3, 5)
    assert (cells.blocks, cells.group, cells.groups) == (14, 4, 4)
    pieces = V._pieces(spark.createDataFrame(rows, "v long, w long, x double"), cells).persist()

    def product(block):
        found = {r["rb"]: np.frombuffer(r["data"], "<f4").reshape(-1, 6) for r in V._times(pieces, block, 6, cells, 9).collect()}
        return np.concatenate([found[i] for i in range(cells.blocks)])

    signs = np.concatenate([V._signs(9, i, 6, cells) for i in range(cells.blocks)])
    np.testing.assert_array_equal(signs, V._signs(9, 0, 6, V.Cells(40, 4)))  # however they are cut
    np.testing.assert_allclose(product(None), dense @ signs, rtol=1e-5)
    columns = rng.standard_normal((40, 6)).astype(np.float32)
    block = spark.createDataFrame([(i, columns[3 * i : 3 * i + 3].tobytes()) for i in range(14)], "rb int, data binary")
    np.testing.assert_allclose(product(block), dense @ columns, rtol=1e-4, atol=1e-3)
    sent = V._sent(block, pieces.where(f"n = {V.MASK}").drop("n"), 6, cells).collect()
    wanted = {(v // 12, w) for v, w in zip(*np.nonzero(dense))}
    assert sum((len(r["data"]) - 1) // 24 for r in sent) == len(wanted) < 4 * 40
    pieces.unpersist()


def test_the_head_is_cut_by_columns(spark):
    """Parts of head blocks add up to the dense product; a rare column goes to one slice, not to all."""
    rng = np.random.default_rng(6)
    dense = np.zeros((60, 60), np.float32)
    for v, w in zip(rng.integers(0, 9, 150), rng.integers(0, 60, 150)):
        dense[v, w] = dense[w, v] = 1 + v + w
    cells = V.Cells(60, 4, 3, 2, head=10)
    assert (cells.blocks, cells.head, cells.slices, cells.group, cells.groups) == (20, 3, 4, 2, 13)
    rows = [(int(v), int(w), float(dense[v, w])) for v, w in zip(*np.nonzero(dense))]
    pieces = V._pieces(spark.createDataFrame(rows, "v long, w long, x double"), cells).persist()
    columns = rng.standard_normal((60, 6)).astype(np.float32)
    block = spark.createDataFrame([(i, columns[3 * i : 3 * i + 3].tobytes()) for i in range(20)], "rb int, data binary")
    parts = V._times(pieces, block, 6, cells).persist()
    assert {r["rb"]: r["count"] for r in parts.groupBy("rb").count().collect()} == {i: 4 if i < 3 else 1 for i in range(20)}
    found = {r["rb"]: np.frombuffer(r["data"], "<f4").reshape(-1, 6) for r in V._whole(parts, cells).collect()}
    np.testing.assert_allclose(np.concatenate([found[i] for i in range(20)]), dense @ columns, rtol=1e-4, atol=1e-3)
    sent = V._sent(block, pieces.where(f"n = {V.MASK}").drop("n"), 6, cells).collect()
    assert sum((len(r["data"]) - 1) // 24 for r in sent if r["cb"] >= 3) == np.count_nonzero(dense[:9, 9:].any(axis=0))
    parts.unpersist()
    pieces.unpersist()


def test_a_head_gives_the_same_products(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(12)) for _ in range(60)]
    none = {r["word"]: np.array(r["v"]) for r in V.pmi_vectors(frame(spark, texts), size=80).collect()}
    some = {r["word"]: np.array(r["v"]) for r in V.pmi_vectors(frame(spark, texts), size=80, block_rows=3, head=20).collect()}
    names = sorted(none)
    assert sorted(some) == names
    a, b = (np.array([t[n] for n in names]) for t in (none, some))
    np.testing.assert_allclose(a @ a.T, b @ b.T, atol=1e-3)


@pytest.mark.parametrize("window", [1, 3, 30])
def test_counts_are_packed_before_they_move(spark, monkeypatch, window):
    """However few pairs are held at a time, and with sentences longer than that."""
    rng = random.Random(7)
    lines = [[rng.randint(-(2**63), 2**63 - 1) if rng.random() < 0.2 else rng.randint(0, 9) for _ in range(rng.choice([1, 2, 9, 90]))] for _ in range(40)]
    want = Counter()
    for line in lines:
        for i, v in enumerate(line):
            for w in line[i + 1 : i + 1 + window]:
                want[min(v, w), max(v, w)] += 1
    monkeypatch.setattr(V, "PAIRED", 60)
    monkeypatch.setattr(V, "MERGED", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(lines[i : i + 7], pa.list_(pa.int64()))], ["_w"]) for i in range(0, 40, 7)]
    sent = sorted(V._line_counts(window, 5)(iter(batches)), key=lambda r: r["cell"][0].as_py())
    assert len({r["cell"][0].as_py() for r in sent}) == 5
    got = [row for r in V._cell_counts(iter(sent)) for row in zip(*(c.to_pylist() for c in r.columns))]
    assert len(got) == len(want)
    assert {(a, b): n for a, b, n in got} == want


def test_vectors_are_not_moved_to_rank_them(spark):
    """Words, targets and cosines are, also where Spark broadcasts nothing by itself."""
    rows = [(f"w{i}", 1, [float(i % 7), 1.0, float(i % 11)]) for i in range(500)]
    vectors = spark.createDataFrame(rows, "word string, n long, v array<float>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = V.nearest_words(vectors, spark.createDataFrame([("w1",)], "word string"), 3)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_blocks_are_small():
    """Parquet puts 100 rows in a page before it looks at its size."""
    assert V.BLOCK * (100 + V.EXTRA) * 4 <= 256 << 10
