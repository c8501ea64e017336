"""Lists and opinions of token tables in any order, and what of them moves."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from sentiloom.operators import annotation as A
from sentiloom.sources import comments as CM
from sentiloom.sources import tables as IO

SCHEMA = "doc_id long, sent_id int, tok_id int, text string, lemma string, upos string, head int, deprel string, ner string"


def tokens(spark, parts):
    rng = random.Random(4)
    rows = []
    for doc in (None, 1, 2**53, 2**53 + 1, *range(10, 40)):
        for sent in range(rng.randint(1, 4)):
            for tok in range(1, rng.randint(2, 9)):
                text = rng.choice(["screen", "bright", "Bad", "xé y", "", None])
                upos = rng.choice(["ADJ", "NOUN", None])
                rows.append((doc, sent, tok, text, text and text.lower(), upos, rng.choice([0, tok + 1, None]), rng.choice(["dep", None]), None))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("per_sentence", [False, True])
@pytest.mark.parametrize("unpacked", [A.UNPACKED, 0])
def test_lists_of_scattered_tokens(spark, monkeypatch, parts, per_sentence, unpacked):
    monkeypatch.setattr(A, "UNPACKED", unpacked)
    rows, df = tokens(spark, parts)
    want = {}
    for r in sorted(rows, key=lambda r: r[1:3]):
        for values, value in zip(want.setdefault(r[: 1 + per_sentence], [[] for _ in A.LISTS]), r[3:]):
            values.append(value)
    got = [tuple(r) for r in A.annotation_lists(df, per_sentence).collect()]
    assert len(got) == len(want)
    assert {r[: 1 + per_sentence]: list(r[1 + per_sentence :]) for r in got} == want


def test_comments_move_packed_and_only_adjectives_are_grouped(spark):
    _, df = tokens(spark, 2)
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan(A.annotation_lists(df))
    below = plan(A.opinion_of(df, "screen")).split("collect_list")[-1]
    assert "= ADJ" in below.split("Filter")[1]
    assert A.annotation_lists(df.limit(0)).collect() == []


def test_opinions_of_all_comments(spark):
    rows, df = tokens(spark, 3)
    want = {}
    for doc in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == doc]
        pairs = [(n[1], n[2], o[2], o[3]) for n in of for o in of if (n[3] or "") == "screen" and o[5] == "ADJ" and o[1] == n[1] and o[6] == n[2]]
        want[doc] = (min(pairs, key=lambda p: p[:3])[3] if pairs else None) or "False"
    got = {r["doc_id"]: r["opinion"] or "False" for r in A.opinion_of(df, "Screen").collect()}
    assert got == want


def test_rows_of_any_type_come_back():
    """Of a batch that is a slice, in runs that begin anywhere."""
    columns = [
        pa.array([9, 1, -(2**31), 2**31 - 1, None, 5, 6, 7, 8], pa.int32()),
        pa.array([9, -(2**63), 2**63 - 1, None, 0, 1, 2, 3, 4], pa.int64()),
        pa.array(["x", "", None, "xé y", "", None, "b", "long" * 99, ""], pa.string()),
        pa.array([None] * 9, pa.string()),
        pa.array([0.5, None, 1.5, 2.5, None, 3.5, 4.5, 5.5, 6.5], pa.float64()),
        pa.array([[1], None, [], [2, 3], [4], None, [5], [6], [7]], pa.list_(pa.int32())),
    ]
    starts = [0, 2, 3, 7]
    for column in (c.slice(1) for c in columns):
        cut = A._cutter(column, starts)
        for low, high in zip(starts, [2, 3, 7, 8]):
            assert A._column(column.type, high - low, cut(low, high)).equals(column.slice(low, high - low))


def test_a_packed_token_takes_few_bytes():
    """Numbers that grow by one and ends of texts are no more than their steps."""
    n = 500
    words = [f"{'ab' * (i % 5 + 1)}{i % 7}" for i in range(n)]
    fields = {"sent_id": pa.array([i // 9 for i in range(n)], pa.int32()), "tok_id": pa.array([i % 9 + 1 for i in range(n)], pa.int32())}
    fields |= {c: pa.array(words) for c in ("text", "lemma", "upos", "deprel", "ner")} | {"head": pa.array(range(n), pa.int32())}
    schema = pa.schema([(k, v.type) for k, v in fields.items()])
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n), *fields.values()], ["doc_id", *fields])
    (row,) = A._packer(schema)(iter([batch]))
    assert len(row["data"][0].as_py()) < 2 * n


def test_files_of_lists_are_compressed(spark, tmp_path):
    rows = [(i, ["screen", None, 'a "b"\n, c', "dep"] * 50) for i in range(40)]
    df = spark.createDataFrame([*rows, (40, []), (None, None)], "doc_id long, text_list array<string>").coalesce(1)
    for _ in range(2):  # what was there is replaced
        IO.write_annotation(df, f"{tmp_path}/csv", f"{tmp_path}/parquet")
    (file,) = (tmp_path / "csv").glob("part-*")
    assert file.name.endswith(".csv.gz")
    assert file.stat().st_size < 4000
    read = spark.read.schema("doc_id long, text_list string").options(**CM.CSV_OPTIONS).csv(f"{tmp_path}/csv")
    read = read.selectExpr("doc_id", "from_json(text_list, 'array<string>') AS text_list")
    want = sorted(df.collect(), key=str)
    assert sorted(read.collect(), key=str) == want
    assert sorted(spark.read.parquet(f"{tmp_path}/parquet").collect(), key=str) == want
