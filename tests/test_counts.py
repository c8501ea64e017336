"""Counts by batch against a recount; replays, compaction, what a batch reads."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentiloom.operators import counts as N
from sentiloom.operators import information as I

BATCHES = (
    [(1, "the camera is good, the lens too"), (2, None), (3, "")],
    [(4, "good good camera"), (4, "good good camera"), (5, "42 !")],
    [(6, "new words only"), (7, "the camera")],
)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string").withColumn("n", F.lit("clash"))


def recount(rows):
    words, df, pairs = Counter(), Counter(), Counter()
    for _, text in rows:
        ws = ["".join(c for c in w if c.isalpha()) for w in (text or "").replace(",", " ").split()]
        ws = [w for w in ws if w]
        words.update(ws)
        df.update(set(ws))
        pairs.update(zip(ws, ws[1:]))
    return {w: (n, df[w]) for w, n in words.items()}, dict(pairs)


def kept(spark, path):
    words = {r["word"]: (r["n"], r["df"]) for r in N.kept_words(spark, path).collect()}
    pairs = {(r["v"], r["w"]): r["n"] for r in N.kept_pairs(spark, path).collect()}
    return words, pairs


def test_three_batches_equal_a_recount(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []
    assert kept(spark, path) == ({}, {}) and N.kept_texts(spark, path).first()["n"] == 0
    for i, rows in enumerate(BATCHES):
        assert N.add_batch(docs(spark, rows), path, f"2024/0{i}")
        seen += rows
        assert kept(spark, path) == recount(seen)
        assert N.kept_texts(spark, path).first()["n"] == len(seen)


def test_replay_replaces_and_merged_batches_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    every = [row for rows in BATCHES for row in rows]
    N.add_batch(docs(spark, BATCHES[2]), path, "a")  # an attempt with other rows
    N.add_batch(docs(spark, BATCHES[0]), path, "a")
    N.add_batch(docs(spark, BATCHES[1]), path, "b")
    assert kept(spark, path) == recount(BATCHES[0] + BATCHES[1])
    assert N.compact(spark, path) == 1 and N.compact(spark, path) == 1
    assert not N.add_batch(docs(spark, BATCHES[2]), path, "b")
    assert kept(spark, path) == recount(BATCHES[0] + BATCHES[1])
    N.add_batch(docs(spark, BATCHES[2]), path, "c")
    N.add_batch(docs(spark, []), path, "none")
    assert kept(spark, path) == recount(every)
    assert N.compact(spark, path) == 2 and kept(spark, path) == recount(every)
    assert N.kept_texts(spark, path).first()["n"] == len(every)


def test_a_compaction_that_dies_counts_nothing_twice(spark, tmp_path, monkeypatch):
    path, write = str(tmp_path / "store"), N._write
    for name, rows in zip("ab", BATCHES):
        N.add_batch(docs(spark, rows), path, name)

    def dies(df, where, by):
        if by == "generation" and where.endswith("merged"):
            raise RuntimeError("lost")
        write(df, where, by)

    monkeypatch.setattr(N, "_write", dies)
    with pytest.raises(RuntimeError):
        N.compact(spark, path)
    monkeypatch.undo()
    assert kept(spark, path) == recount(BATCHES[0] + BATCHES[1])
    N.add_batch(docs(spark, BATCHES[2]), path, "c")
    N.compact(spark, path)
    assert kept(spark, path) == recount([row for rows in BATCHES for row in rows])


def test_merged_deltas_are_not_read_again(spark, tmp_path):
    path = str(tmp_path / "store")
    for name, rows in zip("abc", BATCHES):
        N.add_batch(docs(spark, rows), path, name)
        if name == "b":
            N.compact(spark, path)
    plan = N.counts(spark, path)._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any(re.search(r"NOT batch#\d+ IN \((a,b|b,a)\)", f) for f in filters), filters


def test_metrics_take_kept_counts(spark, tmp_path):
    path = str(tmp_path / "store")
    table = docs(spark, [row for rows in BATCHES for row in rows if row[0] != 4])
    N.add_batch(table, path, "all")
    words, pairs = N.kept_words(spark, path), N.kept_pairs(spark, path)
    rounded = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=repr)
    assert rounded(I.bigram_lm(table, words=words, pairs=pairs)) == rounded(I.bigram_lm(table))
    assert rounded(I.unigram_lm(table, counts=words)) == rounded(I.unigram_lm(table))


def test_a_batch_needs_a_name(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        N.add_batch(docs(spark, []), str(tmp_path), "")


def test_words_are_counted_without_sorting_a_text(spark):
    docs = spark.createDataFrame([("b a b",), ("a",), ("",), (None,), ("a",)], "text string")
    for df in (I.word_statistics(docs.withColumn("doc_id", F.lit(1))), N.batch_counts(docs)):
        assert "sort_array" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in N.batch_counts(docs).collect()} == {
        ("a", None, 3, 3), ("b", None, 2, 1), ("b", "a", 1, 0), ("a", "b", 1, 0), (None, None, 5, 0)
    }
