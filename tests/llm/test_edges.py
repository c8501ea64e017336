"""Nulls, empty and very long texts, repeated rows, empty tables, clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sentiloom.llm import (
    decontaminate,
    embeddings,
    language,
    licenses,
    mixing,
    pii,
    quality,
    shards,
    simhash,
    urls,
)

# names that operators use themselves
CLASHES = (
    "row place key size tokens score shard slot copies target fingerprint component_id n_words n_hit items spans languages"
    " lang_pred host path verdict template purity same order hash rank step base found shingles"
).split()
LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t", "en", None),
    (None, "one lonely word", "en", "a"),
    (4, LONG, "en", "b"),
    (5, "der hund und die katze sind im haus", "de", "b"),
    (5, "der hund und die katze sind im haus", "de", "b"),
    (6, "der hund und die katze sind im haus", None, ""),
    (7, "12345 !!! 67.8", "en", "a"),
    (8, "the dog and the cat are in the house \U0001f600 now", "en", "a"),
    (9, "x" * 200_000, "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, "the dog and"), (2, None), (3, ""), (None, "katze"), (1, "the dog and"), (4, "alpha beta gamma delta " * 3)],
        "item_id long, text string",
    )


def test_languages(docs):
    model = language.fit(docs)
    assert model.languages == ["de", "en"]
    found = language.identify(docs, model).select("row.doc_id", "lang_pred", "score").collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[7] == ("und", 0.0)
    assert by_id[5][0] == by_id[6][0] == "de" and by_id[4][0] == "en"
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    assert language.known_language(docs, model).columns == docs.columns
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, none).select("lang_pred").collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_fingerprints(docs):
    got = {}
    for r in simhash.classes(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert got[1] == got[2] == got[3] == [(0, 1)]
    assert len(got[5]) == 2 and {c for _, c in got[5]} == {5} and got[6][0][1] == 5
    assert got[None][0][1] is None
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 5, 7, 8, 9, None]
    assert simhash.classes(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0


def test_contamination(docs, bench):
    found = decontaminate.contamination(docs, bench)
    got = {r["doc_id"]: r for r in found.select("row.doc_id", "n_words", "n_hit", "items", "spans").collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0
    assert got[8]["items"] == ["1"] and got[8]["n_hit"] == 3 and [tuple(s) for s in got[8]["spans"]] == [(0, 11)]
    assert got[4]["n_hit"] == got[4]["n_words"] == 80_000 and [tuple(s) for s in got[4]["spans"]] == [(0, len(LONG) - 1)]
    assert got[5]["n_hit"] == 0  # an item without an id is left out
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.clean(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        decontaminate.contamination(docs, bench, most_bytes=3)


def test_mix(docs):
    columns = ["row.doc_id", "row.source", "size", "source_size", "target", "copies"]
    rows = mixing.mix(docs).select(*columns).collect()
    assert len(rows) == len(ROWS)
    size = {r["source"]: r["source_size"] for r in rows}
    assert size == {None: 0, "": 8, "a": 17, "b": 80_016, "c": 1}
    assert all(r["target"] <= 2 * r["source_size"] and 0 <= r["copies"] <= 2 for r in rows)
    for s in size:
        taken = sum(r["size"] * r["copies"] for r in rows if r["source"] == s)
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken - next(r["target"] for r in rows if r["source"] == s)) <= max(largest, 1)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).select(*columns).collect()))
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_shards(docs):
    rows = shards.shards(docs, 3).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot").collect()
    assert len(rows) == len(ROWS)
    for k in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert {r["size"] for r in rows if not r["text"]} == {16} and {r["text_crc32"] for r in rows if not r["text"]} == {0}
    assert shards.shards(docs.limit(0), 3).count() == 0


def test_pii(docs):
    got = pii.find(docs).collect()
    assert len(got) == len(ROWS) and all(r["base"] == [] for r in got)
    assert pii.find(docs.limit(0)).count() == 0


def test_licenses(docs):
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="words"):
        licenses.scan(docs, {"short": "two words"})


def test_quality(spark, docs):
    labels = spark.createDataFrame([(5, 1), (8, 0), (1, 1), (4, None), (None, 1)], "doc_id long, quality int")
    net = quality.fit(docs, labels, epochs=1)
    got = quality.scored(docs, net).select("row.doc_id", "score").collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    blank = quality.fit(docs.limit(0), labels)
    assert {r["score"] for r in quality.scored(docs, blank).select("score").collect()} == {0.5}
    assert quality.scored(docs.limit(0), net).count() == 0


def test_urls(spark, docs):
    repeated = (4, "http://A.Example.ORG/es/1?x")
    rows = [(1, None), (2, ""), (3, "no scheme"), repeated, repeated, (5, "://"), (6, "ftp://h" + "/a1" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for c in CLASHES:
        pages = pages.withColumn(c, F.lit(c))
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "example.org/es/")]
    got = urls.judged(pages, rules).select("row.page_id", "host", "path", "rule", "verdict", "template").collect()
    assert len(got) == 7
    by_id = {r["page_id"]: r for r in got}
    one = by_id[4]
    assert (one["host"], one["path"], one["rule"], one["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by_id[1]["host"] == by_id[3]["path"] == "" and by_id[1]["verdict"] == "allow"
    assert by_id[6]["template"].endswith("**")
    assert urls.judged(pages.limit(0), rules).count() == 0 and urls.judged(pages, []).count() == 7


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0])]
    rows = [*odd, (8, [1.0, 0.0]), (9, [2.0, 0.0]), (9, [1.0, 0.1]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {}
    for r in embeddings.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert all(got[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6, 7, 10))
    assert got[8] == [(2, 8, True)] and got[9] == [(2, 8, False)] * 2
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id < 5")).count() == 4


def test_pipeline_stages(spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, str(tmp_path))
            if name == "sharding":
                assert got.columns == [*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot"]
            else:
                assert got.columns == docs.columns, name
            got.collect()
