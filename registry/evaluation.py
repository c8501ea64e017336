"""Queries: labels, splits, slices and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import common as C
from sentiloom.functions import responses as R
from sentiloom.operators import evaluate as E
from sentiloom.operators import shape as S
from sentiloom.plans import evaluation as P

QUERIES, ORACLE, query = C.registry()


WITH = f"WITH {C.SQL_PREDICTIONS}, {C.SQL_SCORED} "
RECORD = (
    "round(100.0::DOUBLE * count(*) FILTER (WHERE gold = pred) / count(*), 3) AS \"Acc_SA\", "
    + C.sql_macro() + ' AS "F1_SA", '
    + C.sql_macro("implicit = 0") + ' AS "F1_ESA", '
    + C.sql_macro("implicit = 1") + ' AS "F1_ISA", '
    + C.sql_macro() + ' AS "default"'
)


@query(
    "label_name",
    WITH
    + """SELECT doc_id, ['positive', 'negative', 'neutral'][gold + 1] AS gold_name,
    ['positive', 'negative', 'neutral'][pred + 1] AS pred_name, pred AS pred_code FROM scored""",
)
def label_name(spark, sf):
    named = C.scored(spark, sf).select(
        "doc_id", R.label_name("gold").alias("gold_name"), R.label_name("pred").alias("pred_name")
    )
    return named.withColumn("pred_code", R.label_code("pred_name"))


@query(
    "split_last_n",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= 150
    THEN 'valid' ELSE 'train' END AS split FROM documents""",
)
def split_last_n(spark, sf):
    return S.split_last_n(C.table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query(
    "eval_slices",
    WITH
    + """SELECT doc_id, gold, pred, unnest(['total', CASE WHEN implicit = 1 THEN 'implicits'
    ELSE 'explicits' END]) AS slice FROM scored""",
)
def eval_slices(spark, sf):
    return S.eval_slices(C.scored(spark, sf)).select("doc_id", "gold", "pred", "slice")


@query(
    "accuracy",
    WITH
    + """SELECT lang, round(100.0::DOUBLE * count(*) FILTER (WHERE gold = pred) / count(*), 3)
    AS accuracy FROM scored GROUP BY lang""",
)
def accuracy(spark, sf):
    return E.accuracy(C.scored(spark, sf), ["lang"])


@query("macro_f1", WITH + f"SELECT lang, {C.sql_macro()} AS macro_f1 FROM scored GROUP BY lang")
def macro_f1(spark, sf):
    return E.macro_f1(C.scored(spark, sf), ["lang"])


@query(
    "macro_f1_by_slice",
    f"""WITH {C.SQL_PREDICTIONS}, {C.SQL_SCORED},
    sliced AS (SELECT gold, pred, unnest(['total', CASE WHEN implicit = 1 THEN 'implicits'
    ELSE 'explicits' END]) AS slice FROM scored)
    SELECT slice, {C.sql_macro()} AS macro_f1 FROM sliced GROUP BY slice""",
)
def macro_f1_by_slice(spark, sf):
    return E.macro_f1_by_slice(C.scored(spark, sf))


@query("report_score", WITH + f"SELECT {RECORD}, 'test' AS mode FROM scored")
def report_score(spark, sf):
    return E.report_score(C.scored(spark, sf))


HISTORY = f"""WITH {C.SQL_PREDICTIONS}, {C.SQL_SCORED},
  records AS (SELECT source AS mode, {RECORD} FROM scored GROUP BY source),
  history AS (SELECT row_number() OVER (ORDER BY mode) - 1 AS idx, mode, "Acc_SA", "F1_SA",
    "F1_ESA", "F1_ISA", "default" FROM records) """


def _history(spark, sf):
    records = E.report_score(C.scored(spark, sf), by=["source"])
    return E.metric_history(records.withColumn("mode", F.col("source")))


@query("metric_history", HISTORY + "SELECT * FROM history")
def metric_history(spark, sf):
    return _history(spark, sf)


@query("best_run", HISTORY + 'SELECT * FROM history ORDER BY "default" DESC, idx LIMIT 1')
def best_run(spark, sf):
    return E.best_run(_history(spark, sf))


@query(
    "evaluate",
    f"""WITH {C.SQL_PREDICTIONS},
    scored AS (SELECT *, {C.sql_exact('answer')} AS pred FROM preds)
    SELECT lang, {RECORD}, 'test' AS mode FROM scored GROUP BY lang""",
)
def evaluate(spark, sf):
    return P.evaluate(C.predictions(spark, sf), by=["lang"])


@query(
    "decode_exact",
    f"WITH {C.SQL_PREDICTIONS} SELECT doc_id, answer, {C.sql_exact('answer')} AS code FROM preds",
)
def decode_exact(spark, sf):
    return C.predictions(spark, sf).select("doc_id", "answer", R.decode_exact("answer").alias("code"))


@query(
    "decode_contains",
    f"WITH {C.SQL_PREDICTIONS} SELECT doc_id, answer, {C.sql_contains('answer')} AS code FROM preds",
)
def decode_contains(spark, sf):
    return C.predictions(spark, sf).select(
        "doc_id", "answer", R.decode_contains("answer").alias("code")
    )


@query(
    "strip_specials",
    f"""WITH {C.SQL_PREDICTIONS} SELECT doc_id,
    {C.sql_strip("replace(replace(answer, '<pad>', ''), '</s>', '')")} AS clean FROM preds""",
)
def strip_specials(spark, sf):
    return C.predictions(spark, sf).select("doc_id", R.strip_specials("answer").alias("clean"))


@query(
    "split_terms",
    """SELECT doc_id, unnest(ts) AS term, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT doc_id, string_split(text, ', ') AS ts FROM documents)""",
)
def split_terms(spark, sf):
    return C.docs(spark, sf).select("doc_id", F.posexplode(R.split_terms("text")).alias("pos", "term"))
