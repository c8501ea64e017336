"""The physical plans are the ones the operators promise."""

import re

from registry import QUERIES, flagship
from pyspark.sql import functions as F

from sentiloom.functions import text as X
from sentiloom.operators import information as I
from sentiloom.operators import lexicon as L

SF = "/root/testdata/sf0.001"
PYTHON = re.compile(r"Python|InPandas|ArrowEval", re.I)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cartesian_outside_the_hook(spark):
    skip = {"infer", "similar_words", "nearest_words", "topics", "corpus_topics", "document_topics", "check_planted_topics", "reduce_embeddings", "read_trace", "score_stored_trace"}
    stored = {"append_labelled", "materialise", "write_bundle", "write_review_csv", "write_annotation", "read_comments", "read_aspect_xml",
              "idempotent_append", "stream_label", "progress_after_append"}
    for name, query in QUERIES.items():
        if name in skip or name in stored:
            continue
        text = plan(query(spark, SF))
        assert not PYTHON.search(text), name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    assert not PYTHON.search(plan(flagship.entry(spark, SF)))


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_row_functions_do_not_shuffle(spark):
    for df in (
        I.entropy(docs(spark)),
        L.mark_modifiers(docs(spark)),
        L.aspects_present(docs(spark), ["work", "best"]),
        I.bow(docs(spark)),
        docs(spark).select(X.truncate_words("text")),
    ):
        assert "Exchange" not in plan(df)


def test_scan_reads_only_what_is_used(spark):
    text = plan(L.compound(docs(spark), L.lexicon_table(spark, {"best": 1.0})))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "BroadcastHashJoin" in text
    pushed = plan(L.mark_modifiers(docs(spark).where(F.col("lang") == "en")))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in pushed


def test_scores_shuffle_only_outcomes(spark):
    text = plan(QUERIES["report_score"](spark, SF))
    assert "Window" not in text and "Expand" not in text and "Generate" not in text


def test_split_needs_no_sort_of_all_rows(spark):
    text = plan(QUERIES["split_last_n"](spark, SF))
    assert "Window" not in text and "TakeOrderedAndProject" in text


def test_a_trace_record_is_made_once(spark):
    for name in ("evaluate_trace", "trace_fields"):
        optimized = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
        made = [n for n in optimized.toString().split("\n+-") if "predicted: " in n]
        assert optimized.toString().count("predicted: ") == 1, (name, made)
