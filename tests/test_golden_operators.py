"""Hand-derived cases and properties of the table operators."""

import math
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sentiloom.operators import annotation as A
from sentiloom.operators import evaluate as E
from sentiloom.operators import information as I
from sentiloom.operators import lexicon as L
from sentiloom.operators import scale
from sentiloom.operators import shape as S
from sentiloom.plans import labelling as J
from sentiloom.plans import reasoning as H


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_remaining_and_quarantine(spark):
    base = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    done = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(S.remaining(base, done, "k")) == [("b",)]
    assert rows(S.without_key(base, "k")) == [(None, "no key")]
    assert rows(S.progress(base, done, "k")) == [(3, 1, 1, 1, 1)]
    assert rows(S.progress(base.limit(0), done, "k")) == [(0, 0, 0, 0, 0)]


def test_joins_by_key_keep_duplicate_texts(spark):
    base = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, text string")
    tokens = spark.createDataFrame([(1, [1]), (2, [1]), (3, [2])], "k int, ids array<int>")
    aspects = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"])], "k int, aspects array<string>")
    joined = S.attach_aspects(S.attach_tokens(base, tokens, "k"), aspects, "k")
    assert S.attach_labels(S.explode_aspects(joined), base, "k").count() == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_index_any_partitioning(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(parts)
    got = scale.dense_index(df, ["k"]).select("k", "idx").collect()
    assert all(r["k"] == r["idx"] for r in got) and len(got) == 1000


@pytest.mark.parametrize("keys", [["a", "b", "c"], ["a", "a", "b"], ["a", None, "b"]])
def test_wide_index_with_and_without_a_key(spark, keys):
    """Repeated or missing order values neither lose nor repeat rows."""
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "k string, text string")
    got = scale.dense_index(df, ["k"], wide=True).orderBy("idx").collect()
    assert [r["idx"] for r in got] == [0, 1, 2] and sorted(r["text"] for r in got) == ["t0", "t1", "t2"]
    order = [r["k"] or "" for r in got]
    assert order == sorted(order)


def test_batches_last_one_is_short(spark):
    got = S.batches(spark.range(25).withColumnRenamed("id", "k"), 10, ["k"]).groupBy("batch_id").count()
    assert rows(got) == [(0, 10), (1, 10), (2, 5)]


def test_split_last_n(spark):
    df = spark.range(400).withColumnRenamed("id", "k")
    got = S.split_last_n(df, ["k"], 150)
    assert rows(got.groupBy("split").count()) == [("train", 250), ("valid", 150)]
    assert got.where("split = 'valid'").agg(F.min("k")).first()[0] == 250


def test_bundle_round_trip_and_mismatch(spark):
    data = [(i, f"t{i}", None if i == 3 else "a", [i], [0], True, i % 3) for i in range(7)]
    df = spark.createDataFrame(
        data,
        "k int, raw_texts string, raw_aspect_terms string, bert_tokens array<int>, aspect_masks array<int>,"
        " implicits boolean, labels int",
    )
    bundle = S.rows_to_bundle(df, ["k"], df.columns[1:], 3)
    assert bundle.count() == 3
    back = S.bundle_to_rows(bundle, "shard").orderBy("shard", "pos").collect()
    assert [(r["text"], r["target"], r["label"]) for r in back] == [(d[1], d[2], d[6]) for d in data]
    uneven = spark.createDataFrame([(["x"], ["a", "b"], [0])], "raw_texts array<string>, raw_aspect_terms array<string>, labels array<int>")
    got = S.bundle_to_rows(uneven).orderBy("pos").collect()
    assert [r["aligned"] for r in got] == [False, False] and [r["implicit"] for r in got] == [0, 0]


def test_align_flags_mismatch(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [5]), (2, None, [6])], "k int, x array<string>, y array<int>")
    got = rows(S.align_by_position(df, ["k"], ["x", "y"]), "k", "pos")
    assert got == [(1, 0, "a", 5, False), (1, 1, "b", None, False), (2, 0, None, 6, False)]


def test_explode_variants(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "k int, aspects array<string>")
    assert S.explode_aspects(df).count() == 1
    assert S.explode_aspects(df, outer=True).count() == 3


def test_pad_batch(spark):
    df = spark.createDataFrame([(0, 1, [5, 6, 7]), (0, 2, [5]), (1, 3, [])], "batch_id int, k int, token_ids array<int>")
    got = {r["k"]: r for r in S.pad_batch(df).collect()}
    assert got[2]["input_ids"] == [5, 0, 0] and got[2]["attention_mask"] == [1, 0, 0]
    assert got[1]["token_type_ids"] == [0, 0, 0] and got[3]["input_ids"] == []


def test_encode_unknown(spark):
    toks = spark.createDataFrame([(1, 0, "b"), (1, 1, "z"), (1, 2, "a")], "doc_id int, pos int, word string")
    vocab = spark.createDataFrame([("a", 10), ("b", 11)], "word string, id bigint")
    assert S.encode(toks, vocab, "doc_id", 1).first()["token_ids"] == [11, 1, 10]
    counted = spark.createDataFrame([("a", 10, 5), ("b", 11, 2)], "word string, id bigint, n bigint")
    assert S.encode(toks, counted, "doc_id", 1).first()["token_ids"] == [11, 1, 10]


def test_encode_tail_words(spark, monkeypatch):
    """Without any broadcast head all words go through the shuffled half."""
    monkeypatch.setattr(scale, "head_cut", lambda *_: F.lit(1 << 40))
    toks = spark.createDataFrame([(1, 0, "b"), (1, 1, "z"), (1, 2, "a")], "doc_id int, pos int, word string")
    counted = spark.createDataFrame([("a", 10, 5), ("b", 11, 2)], "word string, id bigint, n bigint")
    assert S.encode(toks, counted, "doc_id", 1).first()["token_ids"] == [11, 1, 10]


def test_head_cut_keeps_rows_and_bytes_in_bounds(spark):
    counts = spark.createDataFrame([("a", 1000), ("b" * 500, 100), ("c", 10), ("d", 1)], "word string, n bigint")
    cut = lambda rows, size: counts.where(F.col("n") >= scale.head_cut(counts, ["word"], rows, size)).count()
    assert [cut(0, 1 << 20), cut(1, 1 << 20), cut(2, 1 << 20), cut(99, 1 << 20)] == [0, 1, 2, 4]
    assert cut(99, 100) == 1 and cut(99, 5) == 0


PRED = [Row(gold=g, pred=p, implicit=0) for g, p in zip((0, 0, 1, 1), (0, 1, 1, 1))]


def test_scores(spark):
    df = spark.createDataFrame(PRED)
    assert E.accuracy(df).first()[0] == 75.0
    assert E.macro_f1(df).first()[0] == pytest.approx(48.889, abs=1e-3)
    record = E.report_score(df, "valid").first()
    assert record["F1_ISA"] == 0.0 and record["default"] == record["F1_SA"] and record["mode"] == "valid"
    assert record["F1_ESA"] == pytest.approx(48.889, abs=1e-3)


def test_best_run_first_on_ties(spark):
    df = spark.createDataFrame([(0, 50.0), (1, 60.0), (2, 60.0)], "idx int, default double")
    assert E.best_run(df).first()["idx"] == 1


def test_metric_history_from_list(spark):
    record = E.report_score(spark.createDataFrame(PRED))
    got = E.metric_history([record, record]).collect()
    assert sorted(r["idx"] for r in got) == [0, 1]
    with pytest.raises(ValueError):
        E.metric_history([])


LEX = {"good": 2.0, "bad": -3.0, "awful": -3.0}


def test_sarcasm_and_compound(spark):
    docs = spark.createDataFrame([(1, "Good good good. Awful!"), (2, "good."), (3, ""), (4, "Bad bad. good")], "doc_id int, text string")
    lex = L.lexicon_table(spark, LEX)
    got = dict((r["doc_id"], r["verdict"]) for r in L.sarcasm(docs, lex).collect())
    assert got[1] == "Potential Sarcasm detected" and got[2] == got[3] == got[4] == "No sarcasm detected"
    scores = dict((r["doc_id"], r["compound"]) for r in L.compound(docs, lex).collect())
    assert scores[1] == pytest.approx(3 / math.sqrt(24)) and scores[3] == 0.0


def test_aspect_sentiment(spark):
    docs = spark.createDataFrame([(1, "A camera is good. The camera is bad."), (2, "no cam\nera"), (3, "x. y")], "doc_id int, text string")
    got = rows(L.aspect_sentiment(docs, ["camera", "x. y"], L.lexicon_table(spark, LEX)))
    assert got[0][:2] == (1, "camera") and got[0][2] == pytest.approx(2 / math.sqrt(19))
    assert got[1] == (3, "x. y", None)


@pytest.mark.parametrize("as_table", [False, True])
def test_aspects_present_table_equals_list(spark, as_table):
    texts = ["the camera cam", "😀camera", "", "ca", "a\nb", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    terms = ["cam", "camera", "a", "😀c", "\n", "the camera cam", "zzz"]
    want = sorted((i, t) for i, x in enumerate(texts) if x for t in terms if t in x)
    given = spark.createDataFrame([(t,) for t in terms], "aspect string") if as_table else terms
    assert rows(L.aspects_present(docs, given)) == want


def test_lookup_join_shuffled_equals_broadcast(spark, monkeypatch):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("word"))
    small = spark.createDataFrame([("hot", 1), ("1", 2), ("5", 3)], "word string, v int")
    for how in ("inner", "left", "left_anti", "left_semi"):
        monkeypatch.setattr(scale, "fits_broadcast", lambda df: True)
        a = scale.lookup_join(big, small, ["word"], how)
        monkeypatch.setattr(scale, "fits_broadcast", lambda df: False)
        b = scale.lookup_join(big, small, ["word"], how)
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def test_fits_broadcast(spark):
    assert scale.fits_broadcast(spark.range(10), 10) and not scale.fits_broadcast(spark.range(11), 10)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert not scale.fits_broadcast(wide, 10, 500)


@pytest.mark.parametrize("head", [1, 3, 1000])
def test_frequency_join(spark, head):
    words = ["a"] * 50 + ["b"] * 5 + ["c", "d", "e"]
    df = spark.createDataFrame(list(enumerate(words)), "id int, word string")
    counts = df.groupBy("word").agg(F.count("*").alias("n"))
    got = scale.frequency_join(df, counts, ["word"], head).select("id", "word", "n")
    want = Counter(words)
    assert rows(got) == [(i, w, want[w]) for i, w in enumerate(words)]


def brute_metrics(texts):
    """Plain definitions of the corpus metrics."""
    words = {i: t.split() for i, t in enumerate(texts)}
    c = Counter(w for ws in words.values() for w in ws)
    pairs = {i: list(zip(ws, ws[1:])) for i, ws in words.items()}
    pc = Counter(p for ps in pairs.values() for p in ps)
    n, v, p = sum(c.values()), len(c), sum(pc.values())
    out = {}
    for i, ws in words.items():
        s = sum(-math.log2(c[w] / n) for w in ws) / len(ws)
        ps = pairs[i]
        cs = sum(-math.log2((pc[x] + 1) / (c[x[0]] + v)) for x in ps) / len(ps) if ps else None
        cm = sum(math.log2((pc[x] / p) / (c[x[0]] / n * c[x[1]] / n)) for x in ps) / len(ps) if ps else None
        out[i] = (s, cs, cm)
    return out


def test_language_metrics_against_brute_force(spark):
    texts = ["a b a b c", "a", "c c c a b d", "e f", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = brute_metrics(texts)
    uni = {r["doc_id"]: r for r in I.unigram_lm(docs).collect()}
    ctx = {r["doc_id"]: r for r in I.bigram_lm(docs).collect()}
    for i, (s, cs, cm) in want.items():
        assert uni[i]["surprisal"] == pytest.approx(s) and uni[i]["perplexity"] == pytest.approx(2**s)
        assert ctx[i]["contextual_surprisal"] == (None if cs is None else pytest.approx(cs))
        assert ctx[i]["contextual_mutual_information_score"] == (None if cm is None else pytest.approx(cm))


def test_review_ranking_nulls_last(spark):
    cols = [*I.RANKING]
    df = spark.createDataFrame([(1, *[None] * 6), (2, 5.0, *[1.0] * 5), (3, 9.0, *[1.0] * 5)], "k int, " + ", ".join(f"{c} double" for c in cols))
    assert [r["k"] for r in I.review_ranking(df, ["k"]).collect()] == [3, 2, 1]
    assert [r["k"] for r in I.review_ranking(df, ["k"], 1).collect()] == [3]


TOKENS = [
    (1, 0, 1, "The", "the", "DET", 3, "det", None),
    (1, 0, 2, "bright", "bright", "ADJ", 3, "amod", None),
    (1, 0, 3, "screen", "screen", "NOUN", 4, "nsubj", None),
    (1, 0, 4, "shines", "shine", "VERB", 0, "root", None),
    (2, 0, 1, "screen", "screen", "NOUN", 0, "root", "X"),
]


def test_annotation(spark):
    from sentiloom.schemas import ANNOTATION

    toks = spark.createDataFrame(TOKENS, ANNOTATION)
    assert rows(A.aspect_candidates(toks)) == [(1, 0, 3, "screen")]
    assert [(r["aspect"], r["opinion"]) for r in A.aspect_opinion_pairs(toks).collect()] == [("screen", "bright")]
    assert rows(A.opinion_of(toks, "SCREEN")) == [(1, "bright"), (2, "False")]
    lists = {r["doc_id"]: r for r in A.annotation_lists(toks).collect()}
    assert lists[1]["text_list"] == ["The", "bright", "screen", "shines"] and lists[1]["ner_list"] == [None] * 4
    assert lists[2]["head_list"] == [0]


def test_check_response_reasons(spark):
    expected = spark.createDataFrame([(0, 10), (1, 1), (2, 1), (3, 1)], "batch_id bigint, expected_n bigint")
    nine = "[" + ",".join(["{'aspectTerm': 'x'}"] * 9) + "]"
    answers = spark.createDataFrame([(0, nine), (1, "[{'aspectTerm': 'x'}]"), (2, "[5]")], "batch_id bigint, response string")
    got = {r["batch_id"]: (r["ok"], r["reject_reason"]) for r in J.check_response(expected, answers).collect()}
    assert got == {0: (False, "wrong length"), 1: (True, None), 2: (False, "entry is not an object"), 3: (False, "no answer")}


def test_label_job_small(spark):
    base = spark.createDataFrame([("1", "the camera"), ("2", "x"), ("3", "x")], "comment_key string, text string")
    done = spark.createDataFrame([("3",)], "comment_key string")
    batched = J.open_batches(base, done, "comment_key", "text")
    aspects = spark.createDataFrame([(0, "[{'aspectTerm': ['camera', 'the']}, {'aspectTerm': 'NONE'}]")], "batch_id bigint, response string")
    label = "{'polarity': %d, 'implicitness': '%s'}"
    labels = spark.createDataFrame(
        [(0, "[" + ", ".join([label % (1, "True"), label % (0, "False"), label % (2, "False")]) + "]")], "batch_id bigint, response string"
    )
    tokens = spark.createDataFrame([("1", [7, 8]), ("2", [9])], "comment_key string, token_ids array<int>")
    terms = spark.createDataFrame([("camera", [8]), ("the", [7]), ("NONE", [])], "aspect string, aspect_ids array<int>")
    out = J.label_comments(base, batched, aspects, labels, tokens, terms)
    got = [(r["comment_key"], r["aspect"], r["aspect_mask"], r["polarity"], r["implicitness"]) for r in out.collect()]
    assert sorted(got) == [("1", "camera", [0, 1], 1, True), ("1", "the", [1, 0], 0, False), ("2", "NONE", [0], 2, False)]
    short = spark.createDataFrame([(0, "[]")], "batch_id bigint, response string")
    assert J.label_comments(base, batched, aspects, short, tokens, terms).count() == 0
    bad = J.rejected_batches(batched, aspects, short).collect()
    assert [(r["step"], r["reject_reason"]) for r in bad] == [("labels", "empty array")]


def test_reasoning_join_equals_hop_by_hop(spark):
    rws = spark.createDataFrame([(1, "s", "t"), (2, "u", "v")], "row_id int, text string, target string")
    answers = spark.createDataFrame([(1, 1, "a\nb</s>"), (1, 2, "o"), (1, 3, "p"), (1, 4, "negative")], "row_id int, hop int, answer string")
    whole = {r["row_id"]: r for r in H.reason(rws, answers).collect()}
    step = H.first_hop(rws)
    for hop in (1, 2, 3, 4):
        step = H.next_hop(step, answers, hop)
    for r in step.collect():
        for c in ("prompt_1", "prompt_2", "prompt_3", "prompt_4", "answer_4"):
            assert r[c] == whole[r["row_id"]][c]
    assert whole[1]["answer_1"] == "a\nb" and whole[1]["predicted"] == 1 and whole[1]["reject_reason"] is None
    assert whole[2]["prompt_2"] is None and whole[2]["predicted"] is None
    assert whole[2]["reject_reason"] == "no answer to hop 1"
    chat = {r["row_id"]: r for r in H.reason(rws, answers, style="chat").collect()}
    assert chat[1]["answer_1"] == "a b" and chat[2]["predicted"] is None


def test_framed_contexts_lose_blanks_between_hops(spark):
    rws = spark.createDataFrame([(1, "good food", " food<pad> ")], "row_id int, text string, target string")
    answers = spark.createDataFrame([(1, 1, " taste </s>"), (1, 2, "nice\nindeed")], "row_id int, hop int, answer string")
    got = H.reason(rws, answers).first()
    assert got["prompt_2"].startswith('Given the sentence "good food", The mentioned aspect is about taste. Based on')
    assert " of food, and why?" in got["prompt_2"]
    assert " of food is nice\nindeed. Based on" in got["prompt_3"]


def test_dialog_history_holds_every_message(spark):
    turns = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(70)], "conv_id int, turn int, role string, text string")
    got = {r["turn"]: [m["text"] for m in r["history"]] for r in H.dialog_history(turns.repartition(5)).collect()}
    assert got == {t: [f"m{i}" for i in range(t + 1)] for t in range(70)}


def test_aspects_of_lists_and_tables_agree(spark):
    docs = spark.createDataFrame([(1, "workplace work"), (2, ""), (3, None)], "doc_id int, text string")
    for terms in (["work", "work", "", "place work"], ["work", "place work", *[f"none{i}" for i in range(100)]]):
        table = spark.createDataFrame([(t,) for t in terms], "aspect string")
        both = [sorted(map(tuple, L.aspects_present(docs, x).collect())) for x in (terms, table)]
        assert both == [[(1, "place work"), (1, "work")]] * 2


def test_split_breaks_ties(spark):
    rows = spark.createDataFrame([(i // 10, i) for i in range(60)], "k int, v int")
    for n in (1, 15, 20, 60, 99):
        assert S.split_last_n(rows, ["k"], n).where("split = 'valid'").count() == min(n, 60)


def test_label_values_are_checked(spark):
    expected = spark.createDataFrame([(i, 2) for i in range(4)], "batch_id int, expected_n int")
    good = "{'polarity': 1, 'implicitness': 'True'}"
    given = [
        (0, f"[{good}, {good}]"),
        (1, f"[{good}, {{'polarity': 7, 'implicitness': 'no'}}]"),
        (2, f"[{good}, {{'polarity': 'bad', 'implicitness': 'maybe'}}]"),
        (3, f"[{good}, {{'polarity': 0, 'implicitness': 'maybe'}}]"),
    ]
    answers = spark.createDataFrame(given, "batch_id int, response string")
    got = {r["batch_id"]: r["reject_reason"] for r in J.check_response(expected, answers, labels=True).collect()}
    assert got == {0: None, 1: "unknown polarity", 2: "unknown polarity", 3: "not a boolean"}


def test_row_key_separates_neighbours(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert S.with_row_key(df, ["x", "y"]).select("row_key").distinct().count() == 4
