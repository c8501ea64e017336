"""Sources, sinks and streams over synthetic files."""

import random

import pytest
from pyspark.sql import functions as F

from sentiloom import schemas
from sentiloom.functions import responses as R
from sentiloom.operators import shape as S
from sentiloom.sources import comments as C
from sentiloom.sources import tables as IO
from sentiloom.streaming import incremental as INC

HEADER = ",".join(schemas.COMMENTS.fieldNames())


def line(i, comment, time="31/03/2024, 21:28:15", key=None):
    quoted = comment.replace('"', '""')
    guarded = f'"=""{key or 7350000000000000000 + i}"""'
    return f'{guarded},,"=""1""",u,n,"{quoted}","{time}",3,No,,,http://x'


RECORDS = [
    line(1, "plain"),
    line(2, "two\nlines"),
    line(3, 'she said "no", twice'),
    line(4, "plain"),
    line(5, "😀 fine"),
    line(6, "late", "2024-03-31"),
    line(7, ""),
]


def export(path, records, header=HEADER, bom=True):
    path.write_text(("﻿" if bom else "") + "\n".join([header, *records]) + "\n", encoding="utf-8")


def test_comment_export(spark, tmp_path):
    export(tmp_path / "a.csv", RECORDS)
    df = C.read_comments(spark, str(tmp_path / "a.csv"))
    got = {r["comment_key"][-1]: r for r in df.collect()}
    assert len(got) == 7 and got["2"]["Comment"] == "two\nlines" and got["3"]["Comment"] == 'she said "no", twice'
    assert got["1"]["Comment ID"] == '="7350000000000000001"' and got["1"]["Digg Count"] == 3
    assert got["5"]["Comment"] == "😀 fine" and str(got["1"]["comment_time"]) == "2024-03-31 21:28:15"
    assert {k: r["reject_reason"] for k, r in got.items() if r["reject_reason"]} == {"6": "bad time", "7": "no text"}
    good, bad = C.split_quarantine(df)
    assert good.count() == 5 and bad.count() == 2 and "reject_reason" not in good.columns


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_export_read_by_many_tasks(spark, tmp_path, end):
    """Splits that begin anywhere in records, against the reader that takes a file whole."""
    rng = random.Random(5)
    pieces = ["word ", "a, b", '"', '""', end, f"{end}{end}", 'x"y', "é😀", '",', f'{end}"', ""]
    comments = ["".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 9]))) for _ in range(900)] + [f"long{end}" * 4000, f'"{end},"' * 3000]
    records = [line(i, c) for i, c in enumerate(comments)]
    records[10:10] = ["", '1,,,,,5" screen,,1,,,,', "odd record", "2,,,,,b\"c\"d,,1,,,,"]
    for name, part in (("a.csv", records), ("b.csv", records[:3]), ("c.csv", [])):
        (tmp_path / name).write_bytes(("\ufeff" + end.join([HEADER, *part]) + end).encode())
    whole = C.prepare_comments(spark.read.schema(C._with_corrupt(schemas.COMMENTS)).options(**C.CSV_OPTIONS).csv(str(tmp_path)))
    want = sorted(map(repr, whole.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = C.read_comments(spark, str(tmp_path))
        assert C._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(map(repr, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_end_inside_quotes():
    cases = {'a,"b': (True, False), 'a ""b': (False, True), 'b",c': (False, False), "plain": (False, True), 'a,"b ""c"" d",e': (False, False), '5" screen,x': (False, False)}
    for text, (out, inside) in cases.items():
        assert C.inside_after(text, False) == out and C.inside_after(text, True) == inside, text


def test_short_export_and_unknown_header(spark, tmp_path):
    (tmp_path / "dev.csv").write_text("Comment ID,Comment\n1,hello\n2,you\n")
    df = C.read_comments(spark, str(tmp_path / "dev.csv"))
    assert [r["Comment"] for r in df.orderBy("comment_key").collect()] == ["hello", "you"]
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="unknown comment header"):
        C.read_comments(spark, str(tmp_path / "odd.csv"))


def test_every_header_is_checked(spark, tmp_path):
    export(tmp_path / "a.csv", RECORDS)
    export(tmp_path / "b.csv", RECORDS, bom=False)
    assert C.read_comments(spark, str(tmp_path)).count() == 14
    export(tmp_path / "c.csv", RECORDS, header=HEADER.replace("Username", "Nick"), bom=False)
    with pytest.raises(Exception, match="unknown comment header"):
        C.read_comments(spark, str(tmp_path)).collect()


def test_read_labelled_merges_files(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.append_labelled(spark.createDataFrame([("a",)], "aspect string"), path)
    IO.append_labelled(spark.createDataFrame([("b", "x")], "aspect string, raw_text string"), path)
    got = IO.read_labelled(spark, path, schemas.LABELLED)
    assert sorted((r["aspect"], r["raw_text"]) for r in got.collect()) == [("a", None), ("b", "x")]


def test_read_labelled_casts_and_fills(spark, tmp_path):
    path = str(tmp_path / "t")
    assert IO.read_labelled(spark, path).count() == 0
    wide = spark.createDataFrame([("a", [1, 2], 1)], "aspect string, token_ids array<bigint>, polarity bigint")
    IO.append_labelled(wide, path)
    IO.append_labelled(wide, path)
    back = IO.read_labelled(spark, path, schemas.LABELLED)
    assert back.schema["token_ids"].dataType == schemas.LABELLED["token_ids"].dataType
    assert [(r["token_ids"], r["raw_text"]) for r in back.collect()] == [([1, 2], None)] * 2


def test_bundle_files(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, f"t{i}", "a", [i], [1], bool(i % 2), 0) for i in range(5)],
        "k int, raw_text string, aspect string, token_ids array<int>, aspect_mask array<int>, implicitness boolean, polarity int",
    )
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        IO.write_bundle(df, path, ["k"], 2, fmt)
        back = S.bundle_to_rows(IO.read_bundle(spark, path, fmt), "shard").orderBy("shard", "pos").collect()
        assert [(r["text"], r["implicit"]) for r in back] == [(f"t{i}", i % 2) for i in range(5)]


@pytest.mark.parametrize("single, files", [(True, 1), (False, None)])
def test_review_csv(spark, tmp_path, single, files):
    df = spark.range(50).select(F.col("id").alias("k"), F.array(F.col("id")).alias("a"), F.lit(' x "y",\nz ').alias("t"))
    path = str(tmp_path / "csv")
    for _ in range(2):
        IO.write_review_csv(df.repartition(4), path, ["k"], single)
    got = spark.read.schema("k bigint, a string, t string, sequential_id bigint").options(**C.CSV_OPTIONS).csv(path)
    assert all(r["k"] == r["sequential_id"] and r["a"] == f"[{r['k']}]" and r["t"] == ' x "y",\nz ' for r in got.collect())
    assert got.count() == 50
    parts = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-")]
    assert files is None or len(parts) == files


def test_trace_files(spark, tmp_path):
    path = str(tmp_path / "trace")
    steps = [F.lit("p"), F.lit("a")] * 4
    df = spark.createDataFrame([("s\n\n\nx", "positive"), ("s2", "negative")], "s string, p string")
    record = R.trace_record("s", F.lit("t"), F.lit("neutral"), F.lit(0), steps, F.col("p"))
    IO.write_trace(df.select(record.alias("record")), path)
    IO.write_trace(df.limit(1).select(record.alias("record")), path)
    got = IO.read_trace(spark, path)
    assert got.count() == 3 and got.where("reject_reason IS NOT NULL").count() == 0
    assert {r["predicted"] for r in got.collect()} == {"positive", "negative"}


def test_materialise_once(spark, tmp_path):
    path = str(tmp_path / IO.cache_name("laptops", "base", "a/b"))
    assert path.endswith("laptops_base_a-b")
    IO.materialise(spark.range(3), path)
    assert IO.materialise(spark.range(9), path).count() == 3


def test_annotated_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<sentences>
        <sentence id="1"><text>Nice screen</text><aspectTerms>
          <aspectTerm term="screen" polarity="positive" from="5" to="11" implicit_sentiment="False" opinion_words="nice"/>
          <aspectTerm term="&quot;os&quot;" polarity="neutral" from="0" to="1" implicit_sentiment="True"/>
        </aspectTerms></sentence>
        <sentence id="1"><text>One</text><aspectTerms><aspectTerm term="a" polarity="negative" from="0" to="1"/></aspectTerms></sentence>
        <sentence id="2"><text>None here</text></sentence></sentences>"""
    )
    got = C.read_aspect_xml(spark, str(tmp_path / "a.xml")).collect()
    assert sorted((r["sentence_id"], r["aspect"] or "", r["implicitness"]) for r in got) == [
        ("1", '"os"', True), ("1", "a", None), ("1", "screen", False), ("2", "", None),
    ]


def test_annotated_xml_keeps_what_is_broken(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        """<sentences>
        <sentence id="1"><text>Nice</text></sentence>
        <sentence id="2"><text>cut</sentence>
        <sentence id="3"></sentence>
        <sentence id="4"><text>Behind it</text></sentence></sentences>"""
    )
    good, refused = C.split_quarantine(C.read_aspect_xml(spark, str(tmp_path)))
    assert sorted((r["sentence_id"], r["text"]) for r in good.collect()) == [("1", "Nice"), ("4", "Behind it")]
    assert sorted((r["reject_reason"], r["_corrupt_record"]) for r in refused.collect()) == [
        ("corrupt record", '<sentence id="2"><text>cut</sentence>'), ("no text", None),
    ]


def test_annotated_xml_round_trip(spark, tmp_path):
    kind = "array<struct<aspect:string,polarity:string,from:int,to:int,implicitness:boolean,opinion_words:string>>"
    rows = [
        ("1", 'a < b & "c" \u00e9\U0001f600', [('"c"', "neutral", 8, 11, True, None), ("a", "positive", 0, 1, False, "b")]),
        ("2", "bell \x07 here", []),
        ("3", "none", None),
    ]
    table = spark.createDataFrame(rows, f"sentence_id string, text string, terms {kind}")
    path = str(tmp_path / "xml")
    C.write_aspect_xml(table, path)
    C.write_aspect_xml(table.limit(0), path)
    got = C.read_aspect_xml(spark, path)
    assert [r["reject_reason"] for r in got.collect()] == [None] * 4
    assert sorted(map(tuple, got.drop("reject_reason", "_corrupt_record").collect()), key=str) == [
        ("1", rows[0][1], 0, *rows[0][2][0]),
        ("1", rows[0][1], 1, *rows[0][2][1]),
        ("2", "bell \ufffd here", None, None, None, None, None, None, None),
        ("3", "none", None, None, None, None, None, None, None),
    ]


def label(rows):
    return rows.select("comment_key", F.length("Comment").alias("n"))


def test_stream_resumes(spark, tmp_path):
    source, sink, state, bad = (str(tmp_path / d) for d in ("in", "out", "state", "bad"))
    (tmp_path / "in").mkdir()
    run = lambda: INC.stream_label(spark, source, sink, state, schemas.COMMENTS, label, bad)
    export(tmp_path / "in" / "a.csv", RECORDS)
    run()
    assert spark.read.parquet(sink).count() == 5 and spark.read.parquet(bad).count() == 2
    run()
    assert spark.read.parquet(sink).count() == 5
    export(tmp_path / "in" / "b.csv", [RECORDS[0], line(8, "new")])
    export(tmp_path / "in" / "c.csv", [line(8, "new")])
    run()
    assert spark.read.parquet(sink).count() == 6


def test_replay_replaces_its_batch(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, aspect int")
    INC.idempotent_append(df, path, "k", 0)
    INC.idempotent_append(df, path, "k", 0)
    assert spark.read.parquet(path).count() == 3
    INC.idempotent_append(df.union(spark.createDataFrame([("c", 1)], df.schema)), path, "k", 1)
    assert spark.read.parquet(path).count() == 4


def test_seen_keys_are_state_and_not_read_from_the_sink(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 9)], "k string, aspect int")
    INC.idempotent_append(df, path, "k", 0)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "a", "b"]
    for p in (tmp_path / "sink" / "batch_id=0").glob("part-*"):
        p.write_text("not read again")
    INC.idempotent_append(df.union(spark.createDataFrame([("c", 1)], df.schema)), path, "k", 1)
    new = spark.read.parquet(f"{path}/batch_id=1")
    assert [tuple(r) for r in new.collect()] == [("c", 1)]


def test_batches_left_by_a_failure_are_taken_up_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    INC.idempotent_append(rows("a"), path, "k", 0)
    rows("a", "b", "c").toDF("key").write.parquet(f"{path}/_keys/keys/batch_id=1")  # laid down, then the driver died
    INC.idempotent_append(rows("b", "d"), path, "k", 2)
    INC.idempotent_append(rows("a", "b", "c", "e"), path, "k", 1)  # run again, with one row more
    got = [(r["batch_id"], r["k"]) for r in spark.read.parquet(path).collect()]
    assert sorted(k for _, k in got) == ["a", "b", "c", "d", "e"]
    assert {(0, "a"), (1, "c"), (2, "d"), (1, "e")} < set(got)


def test_second_export_of_a_key_is_known_after_a_restart(spark, tmp_path):
    source, sink, state, bad = (str(tmp_path / d) for d in ("in", "out", "state", "bad"))
    (tmp_path / "in").mkdir()
    asked = tmp_path / "asked"

    def counting(rows):
        with asked.open("a") as f:
            f.write(f"{rows.count()}\n")
        return label(rows)

    for n, records in enumerate([RECORDS, [*RECORDS, line(9, "more"), line(9, "more")], RECORDS]):
        export(tmp_path / "in" / f"{n}.csv", records)
        INC.stream_label(spark, source, sink, state, schemas.COMMENTS, counting, bad)
    assert asked.read_text().split() == ["5", "1", "0"]
    assert spark.read.parquet(sink).count() == 6
    reasons = sorted(r["reject_reason"] for r in spark.read.parquet(bad).collect())
    assert reasons == ["bad time"] * 3 + ["no text"] * 3 + ["repeated 1"]


def test_folder_with_two_kinds_of_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Comment ID,Comment\n"=""7""","one\nline, two"\n', encoding="utf-8")
    header = ",".join(schemas.COMMENTS.fieldNames())
    (tmp_path / "b c.csv").write_text(f'{header}\n"=""8""",,u,n,k,text,"31/03/2024, 21:28:15",3,No,0,No,h\n', encoding="utf-8")
    got = {r["comment_key"]: r for r in C.read_comments(spark, str(tmp_path)).collect()}
    assert set(got) == {"7", "8"} and all(r["reject_reason"] is None for r in got.values())
    assert got["7"]["Comment"] == "one\nline, two" and got["7"]["Digg Count"] is None
    assert got["8"]["Comment"] == "text" and got["8"]["Digg Count"] == 3
    (tmp_path / "z.csv").write_text("x,y\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError, match="z.csv"):
        C.read_comments(spark, str(tmp_path))


def test_first_copy_is_the_same_in_every_run(spark):
    rows = [("a", None, "x"), ("a", "2024-01-02 00:00:00", "y"), ("a", "2024-01-01 00:00:00", "z"), ("b", None, "p"), ("b", None, "q")]
    df = spark.createDataFrame(rows, "comment_key string, t string, Comment string").withColumn("comment_time", F.col("t").cast("timestamp"))
    got = [
        {r["comment_key"]: (r["Comment"], r["_copies"]) for r in INC.first_copies(df.repartition(n), "comment_key").collect()}
        for n in (1, 3, 5)
    ]
    assert got[0] == got[1] == got[2] and got[0]["a"] == ("z", 3) and got[0]["b"][1] == 2
