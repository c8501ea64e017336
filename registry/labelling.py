"""Queries: the labelling job and what it sets aside."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import common as C
from sentiloom import constants as K
from sentiloom.functions import text as X
from sentiloom.operators import shape as S
from sentiloom.plans import labelling as J
from sentiloom.sources import tables as IO

QUERIES, ORACLE, query = C.registry()


# Answers by rule.  A batch that holds 'idiot' gets one entry too few.  Labels of
# texts with 'pathetic' have polarity 7, those of texts with 'moron' no boolean.
# Spanish texts of source src3 are missing.
def base_rows(spark, sf):
    gone = (F.col("lang") == "es") & (F.col("source") == "src3")
    base = C.docs(spark, sf, "doc_id", "text", "lang", "source")
    return base.withColumn("text", F.when(~F.coalesce(gone, F.lit(False)), F.col("text")))


def job_inputs(spark, sf):
    base = base_rows(spark, sf)
    opened = J.open_batches(base, C.table(spark, sf, "labels"), "doc_id", "text")
    batched = IO.materialise(opened, f"{C.scratch(spark)}/batches")  # answers refer to these numbers
    held = X.contained("text", C.ASPECTS)
    value = F.when(F.array_size(held) == 0, '"NONE"').when(
        F.array_size(held) == 1, F.concat(F.lit('"'), F.get(held, F.lit(0)), F.lit('"'))
    ).otherwise(F.to_json(held))
    entry = F.concat(F.lit('{"aspectTerm": '), value, F.lit("}"))
    per_batch = (
        batched.select("batch_id", "pos", entry.alias("e"), F.contains("text", F.lit("idiot")).alias("bad"))
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "e")))["e"].alias("es"), F.max("bad").alias("bad"))
    )
    kept = F.slice("es", 1, F.array_size("es") - F.col("bad").cast("int"))
    aspects = per_batch.select(
        "batch_id", F.concat(F.lit("Here:\n["), F.array_join(kept, ", "), F.lit("]\n")).alias("response")
    )
    pairs = J.aspect_rows(batched, aspects)
    polarity = F.when(F.contains("text", F.lit("pathetic")), 7).when(F.contains("text", F.lit("stupid")), 1).when(F.contains("text", F.lit("best")), 0).otherwise(2)
    implied = F.when(F.contains("text", F.lit("moron")), "'maybe'").when(F.length("aspect") > 5, "'True'").otherwise("'False'")
    label = F.concat(F.lit("{'polarity': "), polarity.cast("string"), F.lit(", 'implicitness': "), implied, F.lit("}"))
    labels = (
        pairs.select("batch_id", "pair_no", label.alias("e"))
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("pair_no", "e")))["e"].alias("es"))
        .select("batch_id", F.concat(F.lit("["), F.array_join("es", ","), F.lit("]")).alias("response"))
    )
    tokens = base.select("doc_id", C.ids_of("text").alias("token_ids"))
    names = [*C.ASPECTS, K.NONE_ASPECT]
    aspect_tokens = spark.createDataFrame([(a, [len(a)]) for a in names], "aspect string, aspect_ids array<int>")
    return base.drop("text"), batched, aspects, labels, tokens, aspect_tokens


GONE = "coalesce(lang = 'es' AND source = 'src3', FALSE)"
TODO = f"""todo AS (SELECT doc_id, text, lang, source, rn // 10 AS batch_id, rn % 10 AS pos FROM (SELECT *,
    row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents ANTI JOIN labels USING (doc_id) WHERE NOT {GONE})),
  bad AS (SELECT batch_id, bool_or(contains(text, 'idiot')) AS bad, bool_or(contains(text, 'pathetic')) AS code,
    bool_or(contains(text, 'moron')) AS flag, count(*) AS n,
    sum(CASE WHEN len({C.SQL_HELD}) = 0 THEN 1 ELSE len({C.SQL_HELD}) END) AS pairs FROM todo GROUP BY batch_id)"""


@query(
    "label_job",
    f"""WITH {TODO}, good AS (SELECT t.* FROM todo t JOIN bad USING (batch_id) WHERE NOT bad AND NOT code AND NOT flag),
    a AS (SELECT doc_id, text, lang, source, CASE WHEN len({C.SQL_HELD}) = 0 THEN ['NONE'] ELSE {C.SQL_HELD} END AS h,
      list_transform(regexp_extract_all(lower(text), '(\\p{{L}}+)'), lambda w: length(w)) AS ids
      FROM good),
    e AS (SELECT *, unnest(h) AS aspect FROM a)
    SELECT doc_id, lang, source, aspect,
      array_to_string(list_transform(ids, lambda i: CASE WHEN i = length(aspect) THEN 1 ELSE 0 END), ',') AS aspect_mask,
      array_to_string(ids, ',') AS token_ids,
      array_to_string(list_transform(ids, lambda i: 0), ',') AS token_type_ids,
      array_to_string(list_transform(ids, lambda i: 1), ',') AS attention_mask,
      length(aspect) > 5 AS implicitness,
      CASE WHEN contains(text, 'stupid') THEN 1 WHEN contains(text, 'best') THEN 0 ELSE 2 END AS polarity,
      text AS raw_text FROM e""",
)
def label_job(spark, sf):
    out = J.label_comments(*job_inputs(spark, sf), key="doc_id")
    lists = ("aspect_mask", "token_ids", "token_type_ids", "attention_mask")
    return out.select(*[C.joined(c).alias(c) if c in lists else F.col(c) for c in out.columns])


@query(
    "rejected_batches",
    f"""WITH {TODO} SELECT 'aspects' AS step, batch_id, n AS expected_n, n - 1 AS actual_n,
    CASE WHEN n = 1 THEN 'empty array' ELSE 'wrong length' END AS reject_reason, FALSE AS ok FROM bad WHERE bad
    UNION ALL SELECT 'labels', batch_id, pairs, pairs, CASE WHEN code THEN 'unknown polarity' ELSE 'not a boolean' END, FALSE
    FROM bad WHERE NOT bad AND (code OR flag)""",
)
def rejected_batches(spark, sf):
    _, batched, aspects, labels, _, _ = job_inputs(spark, sf)
    return J.rejected_batches(batched, aspects, labels)


@query(
    "open_batches",
    f"WITH {TODO} SELECT doc_id, text, batch_id, pos FROM todo",
)
def open_batches(spark, sf):
    return J.open_batches(base_rows(spark, sf), C.table(spark, sf, "labels"), "doc_id", "text")


@query(
    "without_text",
    f"SELECT doc_id, 'no text' AS reject_reason FROM documents ANTI JOIN labels USING (doc_id) WHERE {GONE}",
)
def without_text(spark, sf):
    out = J.without_text(base_rows(spark, sf), C.table(spark, sf, "labels"), "doc_id", "text")
    return out.select("doc_id", "reject_reason")


@query(
    "without_key",
    """SELECT doc_id, 'no key' AS reject_reason FROM documents LEFT JOIN labels USING (doc_id)
    WHERE labels.quality IS NULL""",
)
def without_key(spark, sf):
    rows = C.table(spark, sf, "documents").select("doc_id").join(C.table(spark, sf, "labels"), "doc_id", "left")
    return S.without_key(rows, "quality").select("doc_id", "reject_reason")
