"""Queries that go through files: write, read back, resume, stream.

They write below the shared checkpoint folder and return what is read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import annotation as AN
from registry import common as C
from registry import prompting as PR
from registry import shaping as SH
from sentiloom import schemas
from sentiloom.functions import responses as R
from sentiloom.functions import text as X
from sentiloom.operators import annotation as A
from sentiloom.operators import shape as S
from sentiloom.plans import evaluation as E
from sentiloom.plans import reasoning as H
from sentiloom.sources import comments as CM
from sentiloom.sources import tables as IO
from sentiloom.streaming import incremental as INC

QUERIES, ORACLE, query = C.registry()


scratch = C.scratch

LABELLED_TEXT = f"""WITH {C.SQL_LABELLED} SELECT raw_text, aspect, array_to_string(token_ids, ',') AS token_ids,
  array_to_string(aspect_mask, ',') AS aspect_mask, implicitness, polarity FROM labelled"""


def _labelled_text(df):
    return df.select(
        "raw_text",
        "aspect",
        C.joined("token_ids").alias("token_ids"),
        C.joined("aspect_mask").alias("aspect_mask"),
        "implicitness",
        "polarity",
    )


@query("append_labelled", LABELLED_TEXT)
def append_labelled(spark, sf):
    path, rows = scratch(spark), C.labelled(spark, sf)
    IO.append_labelled(rows.where("implicitness"), path)
    IO.append_labelled(rows.where("NOT implicitness"), path)
    return _labelled_text(IO.read_labelled(spark, path, schemas.LABELLED))


@query("materialise", LABELLED_TEXT)
def materialise(spark, sf):
    path = f"{scratch(spark)}/{IO.cache_name('documents', 'base', 'words/lengths')}"
    IO.materialise(C.labelled(spark, sf), path)
    return _labelled_text(IO.materialise(C.labelled(spark, sf).limit(0), path))


@query("write_bundle", SH.ORACLE["bundle_to_rows"])
def write_bundle(spark, sf):
    path = scratch(spark)
    IO.write_bundle(C.labelled(spark, sf), path, ["doc_id", "aspect"], SH.PER_BUNDLE)
    return S.bundle_to_rows(IO.read_bundle(spark, path), "shard")


def _stored_trace(spark, sf):
    path = scratch(spark)
    reasoned = H.reason(*PR.reasoning_inputs(spark, sf), style="chat")
    for flag in (0, 1):
        IO.write_trace(H.trace_records(reasoned.where(F.col("implicit") == flag)), path)
    return IO.read_trace(spark, path)


@query("read_trace", PR.ORACLE["trace_fields"])
def read_trace(spark, sf):
    return _stored_trace(spark, sf).drop("record")


@query("score_stored_trace", PR.ORACLE["evaluate_trace"])
def score_stored_trace(spark, sf):
    return E.evaluate_trace(_stored_trace(spark, sf))


@query(
    "write_review_csv",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sequential_id, doc_id, lang, text,
    '[' || array_to_string(list_transform(regexp_extract_all(text, '([^.!?\\n]+[.!?]?)'), lambda s: length(s)), ',') || ']'
    AS lengths FROM documents""",
)
def write_review_csv(spark, sf):
    path = scratch(spark)
    rows = C.docs(spark, sf, "doc_id", "lang", "text").withColumn(
        "lengths", F.transform(X.sentences("text"), F.length)
    )
    IO.write_review_csv(rows, path, ["doc_id"])
    schema = "doc_id bigint, lang string, text string, lengths string, sequential_id bigint"
    return spark.read.schema(schema).options(**CM.CSV_OPTIONS).csv(path)


@query("write_annotation", AN.ORACLE["annotation_lists"])
def write_annotation(spark, sf):
    path = scratch(spark)
    lists = A.annotation_lists(AN.annotation(spark, sf))
    IO.write_annotation(lists, f"{path}/csv", f"{path}/parquet")
    schema = "doc_id bigint, " + ", ".join(f"{c}_list string" for c in A.LISTS)
    stored = spark.read.schema(schema).options(**CM.CSV_OPTIONS).csv(f"{path}/csv")
    parsed = stored.select(
        "doc_id", *[F.from_json(f"{c}_list", "array<string>").alias(f"{c}_list") for c in A.LISTS]
    )
    return AN._text_lists(parsed, ["doc_id"])


def _export(docs, path: str) -> None:
    """Documents as a comment export: guarded ids, quotes doubled, line feeds kept."""
    guarded = F.concat(F.lit('="'), F.col("doc_id").cast("string"), F.lit('"'))
    docs.select(guarded.alias("Comment ID"), F.col("text").alias("Comment")).write.mode("append").options(
        **IO.CSV_WRITE, quoteAll=True
    ).csv(path)


@query("read_comments", "SELECT doc_id::VARCHAR AS comment_key, text, NULL::VARCHAR AS reject_reason FROM documents")
def read_comments(spark, sf):
    path = scratch(spark)
    _export(C.docs(spark, sf), path)
    rows = CM.read_comments(spark, path)
    return rows.select("comment_key", F.col("Comment").alias("text"), "reject_reason")


@query("idempotent_append", "SELECT doc_id, lang FROM documents")
def idempotent_append(spark, sf):
    """First the labelled documents, then all of them, then the second again."""
    path, docs = scratch(spark), C.docs(spark, sf, "doc_id", "lang")
    INC.idempotent_append(docs.join(C.table(spark, sf, "labels"), "doc_id", "left_semi"), path, "doc_id", 0)
    for _ in range(2):
        INC.idempotent_append(docs, path, "doc_id", 1)
    return spark.read.parquet(path).select("doc_id", "lang")


@query(
    "stream_label",
    f"SELECT doc_id::VARCHAR AS comment_key, {C.sql_contains('text')} AS polarity FROM documents",
)
def stream_label(spark, sf):
    """Two rounds; the second export repeats every comment of the first."""
    path, docs = scratch(spark), C.docs(spark, sf)

    def label(rows):
        return rows.select("comment_key", R.decode_contains("Comment").alias("polarity"))

    first = docs.join(C.table(spark, sf, "labels"), "doc_id", "left_semi")
    for part in (first, docs):
        _export(part, f"{path}/in")
        INC.stream_label(spark, f"{path}/in", f"{path}/out", f"{path}/state", schemas.COMMENTS_SHORT, label)
    return spark.read.parquet(f"{path}/out").select("comment_key", "polarity")


@query("progress_after_append", SH.ORACLE["progress"])
def progress_after_append(spark, sf):
    path = scratch(spark)
    IO.append_labelled(C.table(spark, sf, "labels").select("doc_id"), path)
    done = IO.read_labelled(spark, path, C.table(spark, sf, "labels").select("doc_id").schema)
    return S.progress(C.table(spark, sf, "documents"), done, "doc_id")


POLARITIES = ("negative", "neutral", "positive")
SQL_TRIMMED = r"trim(regexp_replace(text, '[\x09\x0A\x0D\x20]+', ' ', 'g'))"


@query(
    "read_aspect_xml",
    f"""WITH a AS (SELECT unnest([{C.sql_list(C.ASPECTS)}]) AS aspect, unnest(range({len(C.ASPECTS)})) AS i),
    hits AS (SELECT doc_id, aspect, strpos(text, aspect) - 1 AS f,
        row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM documents, a WHERE contains(text, aspect))
    SELECT doc_id::VARCHAR AS sentence_id, {SQL_TRIMMED} AS text, pos::INTEGER AS aspect_pos, aspect,
        [{C.sql_list(POLARITIES)}][(length(aspect) % 3 + 1)::INTEGER] AS polarity, f::INTEGER AS "from", (f + length(aspect))::INTEGER AS "to",
        CASE WHEN aspect IS NOT NULL THEN doc_id % 2 = 0 END AS implicitness,
        CASE WHEN text IS NULL THEN 'no text' END AS reject_reason
    FROM documents LEFT JOIN hits USING (doc_id)
    UNION ALL SELECT NULL, '<sentence id="' || lang || '"><text>cut</sentence>', NULL, NULL, NULL, NULL, NULL, NULL, 'corrupt record'
    FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)""",
)
def read_aspect_xml(spark, sf):
    """All texts as annotated XML, with a broken record for each language beside them."""
    path, docs = scratch(spark), C.docs(spark, sf, "doc_id", "text", "lang")
    term = lambda a: F.struct(
        F.lit(a).alias("aspect"),
        F.lit(POLARITIES[len(a) % 3]).alias("polarity"),
        (F.instr("text", a) - 1).alias("from"),
        (F.instr("text", a) - 1 + len(a)).alias("to"),
        (F.col("doc_id") % 2 == 0).alias("implicitness"),
        F.lit(None).cast("string").alias("opinion_words"),
    )
    terms = F.array_compact(F.array(*[F.when(F.instr("text", a) > 0, term(a)) for a in C.ASPECTS]))
    CM.write_aspect_xml(docs.select(F.col("doc_id").alias("sentence_id"), "text", terms.alias("terms")), path)
    broken = F.concat(F.lit('<sentence id="'), "lang", F.lit('"><text>cut</sentence>'))
    docs.where(F.col("lang").isNotNull()).select("lang").distinct().select(broken).write.mode("append").text(path)
    text = F.trim(F.regexp_replace(F.coalesce("text", "_corrupt_record"), r"[\x09\x0A\x0D\x20]+", " "))
    return CM.read_aspect_xml(spark, path).select(
        "sentence_id", text.alias("text"), "aspect_pos", "aspect", "polarity", "from", "to", "implicitness", "reject_reason"
    )
