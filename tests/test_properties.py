"""Random inputs against plain Python definitions."""

import random
import re

from pyspark.sql import functions as F

from sentiloom import constants as K
from sentiloom.functions import arrays as A
from sentiloom.functions import text as X
from sentiloom.operators import lexicon as L
from sentiloom.operators import scale
from sentiloom.operators import shape as S

WORDS = ["not", "No", "never", "VERY", "extremely", "good", "it's", ",", "!", "7", "Ça", "sehr"]


def marked(tokens):
    """Each plain token carries the kinds of the modifiers right before it."""
    out = []
    for i, t in enumerate(tokens):
        if t.lower() in K.NEGATIONS + K.INTENSIFIERS:
            out.append(t)
            continue
        j = i
        while j and tokens[j - 1].lower() in K.NEGATIONS + K.INTENSIFIERS:
            j -= 1
        before = {w.lower() for w in tokens[j:i]}
        out.append(
            ("INTENSIFIED_" if before & set(K.INTENSIFIERS) else "")
            + ("NOT_" if before & set(K.NEGATIONS) else "")
            + t
        )
    return " ".join(out)


def test_mark_modifiers_random(spark):
    rng = random.Random(1)
    texts = [[rng.choice(WORDS) for _ in range(rng.randrange(12))] for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in L.mark_modifiers(df).collect():
        assert r["marked"] == marked(texts[r["doc_id"]])


def test_mask_random(spark):
    rng = random.Random(2)
    data = []
    for i in range(400):
        ids = [rng.randrange(3) for _ in range(rng.randrange(10))]
        data.append((i, ids, [rng.randrange(3) for _ in range(rng.randrange(4))]))
    df = spark.createDataFrame(data, "k int, ids array<int>, a array<int>")
    for r in df.withColumn("m", A.aspect_mask("ids", "a")).collect():
        ids, a = r["ids"], r["a"]
        runs = [i for i in range(len(ids) - len(a) + 1) if a and ids[i : i + len(a)] == a]
        assert r["m"] == [int(any(i <= j < i + len(a) for i in runs)) for j in range(len(ids))]


def test_tokens_random(spark):
    rng = random.Random(3)
    alphabet = "aB é.!?\n'’9\t"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = df.select("k", X.words("text").alias("w"), X.sentences("text").alias("s"), X.truncate_words("text", 3).alias("t"))
    for r in got.collect():
        text = texts[r["k"]]
        assert r["w"] == re.findall(r"[^\W\d_]+", text.lower())
        assert r["s"] == re.findall(r"[^.!?\n]+[.!?]?", text)
        assert r["t"] == " ".join(text.split()[:3])


def test_explode_then_collect_restores(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, ["c"])], "k int, aspects array<string>")
    back = S.explode_aspects(df).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("aspect_pos", "aspect")))["aspect"].alias("aspects"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_remaining_and_done_make_the_base(spark):
    base = spark.range(100).withColumnRenamed("id", "k")
    done = base.where("k % 7 < 3").union(spark.createDataFrame([(500,)], "k bigint"))
    left = S.remaining(base, done, "k")
    assert left.join(done, "k", "left_semi").count() == 0
    assert left.count() + base.join(done, "k", "left_semi").count() == 100


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(WORDS + ["best", "idiot"]) for _ in range(30)) + ". best!") for i in range(60)]
    lex = L.lexicon_table(spark, {"best": 2.0, "idiot": -3.0, "no": -0.5})
    seen = []
    for parts in (1, 7):
        df = spark.createDataFrame(data, "doc_id int, text string").repartition(parts)
        seen.append(
            [
                sorted(map(tuple, L.sarcasm(df, lex).collect())),
                sorted(map(tuple, S.batches(df.select("doc_id"), 7, ["doc_id"]).collect())),
                sorted(map(tuple, L.compound(df, lex).collect())),
            ]
        )
    assert seen[0] == seen[1]


def test_hot_key_keeps_every_row(spark):
    """A third of all rows share one word; both halves of the lookup stay whole."""
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") / 2).cast("int"))).alias("word"))
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    for head in (1, 50):
        got = scale.frequency_join(rows, counts, ["word"], head)
        assert got.count() == 9000 and got.where("word = 'hot'").agg(F.min("n")).first()[0] == 3000
        assert got.join(counts.withColumnRenamed("n", "m"), "word").where("n <> m").count() == 0
