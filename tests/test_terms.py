"""Terms of a table, found at all places of the texts."""

import random

import numpy as np

from sentiloom.operators import lexicon as L
from sentiloom.operators import terms


def _found(spark, texts, names):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(t,) for t in names], "aspect string")
    return docs, table, sorted(map(tuple, L.aspects_present(docs, table).collect()))


def test_terms_of_any_length_equal_a_plain_search(spark):
    draw = random.Random(3)
    texts = [None, "", "x"] + ["".join(draw.choice("abé€ \0") for _ in range(draw.randrange(120))) for _ in range(60)]
    whole = [t for t in texts if t]
    names = {t[i : i + n] for n in (1, 2, 7, 8, 9, 16, 17, 40, 200) for t in draw.sample(whole, 12) for i in [draw.randrange(len(t))]}
    names |= {"ab" * 4, "ab" * 4 + "c", "zzz", "é", "€"}
    want = sorted((i, n) for i, t in enumerate(texts) for n in names if n and t and n in t)
    assert _found(spark, texts, [*names, "", None, "é"])[2] == want


def test_terms_across_the_places_looked_at_in_one_go():
    data = ("ab" * 30 + "needle that is long" + "ab" * 30).encode()
    known = terms.Terms([b"needle that is long", b"ba", b"needle", b"gab"])
    bytes_, ends = np.frombuffer(data * 2, np.uint8), np.array([len(data), 2 * len(data)])
    for step in (1, 7, 64, 1000):
        places = range(0, len(bytes_), step)
        hits = {int(h) for low in places for h in known.found(bytes_, ends, low, min(low + step, len(bytes_)))}
        assert hits == set(range(8))
    assert set(known.found(np.frombuffer(b"needle that is longneedle", np.uint8), np.array([10, 25]), 0, 25)) == {2, 6}


def test_places_of_a_text_are_no_rows(spark):
    docs, table, _ = _found(spark, ["one"], ["on"])
    text = L.aspects_present(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "Join" not in text and "Exchange" not in text


def test_a_larger_table_is_joined_with_the_same_result(spark, monkeypatch):
    texts, names = ["one two", "twofold", None, ""], ["two", "o", "fold", "twofold", "none"]
    few = _found(spark, texts, names)[2]
    monkeypatch.setattr(L, "fits_broadcast", lambda df: False)
    assert _found(spark, texts, names)[2] == few == [(0, "o"), (0, "two"), (1, "fold"), (1, "o"), (1, "two"), (1, "twofold")]
