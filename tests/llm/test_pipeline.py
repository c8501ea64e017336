"""Every stage of the pipeline against a plain version of what it has to keep."""

import re
from collections import Counter

import corpus_pipeline
import pytest
import xxhash

from sentiloom.llm import language, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into and comes out of each stage, rows as plain tuples."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert list(stages) == ["language_identification", "near_duplicates", "benchmark_passages", "source_weights", "sharding"]
    for name, (before, after) in stages.items():
        assert after.columns == before.columns + (["shard", "slot"] if name == "sharding" else [])


def test_documents_with_a_language_stay(stages):
    before, after = stages["language_identification"]
    found = language.identify(before, language.fit(before)).select("row.doc_id", "lang_pred", "score").collect()
    assert ids(after) == Counter(r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.3)


def test_one_of_each_class_stays(stages):
    before, after = stages["near_duplicates"]
    prints = {}
    for r in before.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    kept, left = [], sorted(prints)
    while left:
        front, group = [left[0]], {left[0]}
        while front:
            x = front.pop()
            near = [y for y in left if y not in group and (prints[x] ^ prints[y]).bit_count() <= 3]
            group.update(near)
            front += near
        kept.append(min(group))
        left = [y for y in left if y not in group]
    assert ids(after) == Counter(kept)


def test_documents_with_benchmark_passages_go(spark, stages):
    before, after = stages["benchmark_passages"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = [
        r["doc_id"]
        for r in before.collect()
        if not any(tuple(w[i : i + n]) in windows for w in [words(r["text"])] for n in sizes for i in range(len(w) - n + 1))
    ]
    assert ids(after) == Counter(clean) and len(clean) < before.count()


def test_sources_get_their_copies(stages):
    before, after = stages["source_weights"]
    rows = mixing.mix(before).select("row.doc_id", "copies").collect()
    assert ids(after) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_every_row_has_a_slot(stages):
    before, after = stages["sharding"]
    rows = after.select("doc_id", "shard", "slot").collect()
    assert ids(after) == ids(before) and {r["shard"] for r in rows} <= set(range(corpus_pipeline.SHARDS))
    for k in range(corpus_pipeline.SHARDS):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
