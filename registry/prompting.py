"""Queries: prompt wording, answers, multi-hop reasoning, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import common as C
from sentiloom import constants as K
from sentiloom.functions import prompts as P
from sentiloom.functions import responses as R
from sentiloom.functions import text as X
from sentiloom.operators.infer import infer as run_model
from sentiloom.operators.infer import infer_stored as ask_once
from sentiloom.plans import evaluation as E
from sentiloom.plans import labelling as J
from sentiloom.plans import reasoning as H
from sentiloom.operators import shape as S

QUERIES, ORACLE, query = C.registry()


def _texts(spark, sf):
    return C.docs(spark, sf, "doc_id", "text", "source", "lang")


def _pair(df, pair):
    return df.select("doc_id", pair[0].alias("context"), pair[1].alias("prompt"))


OPEN = "'Given the sentence \"' || text || '\", '"


@query(
    "prompt_direct",
    f"""SELECT doc_id, {OPEN} AS context, {OPEN} || 'what is the sentiment polarity towards ' || source || '?'
    AS prompt FROM documents""",
)
def prompt_direct(spark, sf):
    return _pair(_texts(spark, sf), P.direct("text", "source"))


@query(
    "prompt_masked",
    f"""SELECT doc_id, {OPEN} AS context, {OPEN} || 'the sentiment polarity towards ' || source || ' is [mask]'
    AS prompt FROM documents""",
)
def prompt_masked(spark, sf):
    return _pair(_texts(spark, sf), P.masked("text", "source"))


@query(
    "prompt_aspect",
    f"""SELECT doc_id, {OPEN} AS context, {OPEN} || 'which specific aspect of ' || source ||
    ' is possibly mentioned?' AS prompt FROM documents""",
)
def prompt_aspect(spark, sf):
    return _pair(_texts(spark, sf), P.aspect("text", "source"))


OPINION_TAIL = (
    "' Based on the common sense, what is the implicit opinion towards the mentioned aspect of '"
    " || source || ', and why?'"
)
POLARITY_TAIL = "' Based on such opinion, what is the sentiment polarity towards ' || source || '?'"


def _styled(sql: str) -> str:
    return f"SELECT doc_id, style, context, context || tail AS prompt FROM ({sql})"


@query(
    "prompt_opinion",
    _styled(
        f"""SELECT doc_id, 'framed' AS style, text || ' The mentioned aspect is about ' || lang || '.' AS context,
        {OPINION_TAIL} AS tail FROM documents UNION ALL
        SELECT doc_id, 'chat', text || ' ' || lang, {OPINION_TAIL} FROM documents"""
    ),
)
def prompt_opinion(spark, sf):
    docs = _texts(spark, sf)
    parts = [
        _pair(docs, P.opinion("text", "source", "lang", s)).withColumn("style", F.lit(s)) for s in P.STYLES
    ]
    return parts[0].unionByName(parts[1])


@query(
    "prompt_polarity",
    _styled(
        f"""SELECT doc_id, 'framed' AS style, text || ' The opinion towards the mentioned aspect of ' || source
        || ' is ' || lang || '.' AS context, {POLARITY_TAIL} AS tail FROM documents UNION ALL
        SELECT doc_id, 'chat', text || ' ' || lang, {POLARITY_TAIL} FROM documents"""
    ),
)
def prompt_polarity(spark, sf):
    docs = _texts(spark, sf)
    parts = [
        _pair(docs, P.polarity("text", "source", "lang", s)).withColumn("style", F.lit(s)) for s in P.STYLES
    ]
    return parts[0].unionByName(parts[1])


FRAMED_LABEL = (
    "' Based on these contexts, summarize and return the sentiment polarity only,"
    " such as positive, neutral, or negative.'"
)
CHAT_LABEL = (
    "' Based on these contexts, summarize the sentiment polarity, and return only one of these words:"
    " positive, neutral, or negative.'"
)


@query(
    "prompt_label",
    f"""SELECT doc_id, text || ' The sentiment polarity is ' || lang || '.' || {FRAMED_LABEL} AS framed,
    lang || {CHAT_LABEL} AS chat FROM documents""",
)
def prompt_label(spark, sf):
    return _texts(spark, sf).select(
        "doc_id", P.label("text", "lang", "framed").alias("framed"), P.label("text", "lang", "chat").alias("chat")
    )


@query(
    "prompt_target",
    f"""SELECT doc_id, {OPEN} || 'what are the target aspect terms being spoken about?' AS targets,
    {OPEN} || 'which specific opinion expression of the ' || source || ' is possibly mentioned?' AS opinion,
    {OPEN} || 'which words or phrases are the aspect terms?' AS terms,
    'Given the sentence "' || text || '", and this/these aspect term(s),"' || source ||
    'determine the polairty (positive, negative or neutral) of aspect term and if it is explicitely or implicitely'
    || ' expressed with respect to the whole sentence?' AS labels FROM documents""",
)
def prompt_target(spark, sf):
    return _texts(spark, sf).select(
        "doc_id",
        P.targets("text")[1].alias("targets"),
        P.opinion_expression("text", "source")[1].alias("opinion"),
        P.aspect_terms("text")[1].alias("terms"),
        P.pair_labels("text", "source").alias("labels"),
    )


BATCHED = f"""batched AS (SELECT doc_id, text, rn // {K.LABELLING_BATCH} AS batch_id, rn % {K.LABELLING_BATCH} AS pos
  FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents))"""
ASK_PAIRS = (
    "'determine the polairty (positive, negative or neutral) of aspect term and if it is explicitely or implicitely"
    " expressed with respect to the whole sentence?'"
)


def _batched(spark, sf):
    return S.batches(C.docs(spark, sf), K.LABELLING_BATCH, ["doc_id"])


@query(
    "prompt_batch_aspects",
    f"""WITH {BATCHED} SELECT batch_id, count(*) AS expected_n, 'Given these sentences "' ||
    to_json(list(text ORDER BY pos))::VARCHAR || '", which words or phrases are the aspect terms?' AS prompt
    FROM batched GROUP BY batch_id""",
)
def prompt_batch_aspects(spark, sf):
    return J.prompt_batch_aspects(_batched(spark, sf)).drop("role")


@query(
    "prompt_batch_labels",
    f"""WITH {BATCHED}, pairs AS (SELECT batch_id, pos, text, unnest(h) AS aspect, generate_subscripts(h, 1) AS k
      FROM (SELECT *, {C.SQL_HELD} AS h FROM batched)),
    t AS (SELECT batch_id, to_json(list(text ORDER BY pos))::VARCHAR AS ts FROM
      (SELECT DISTINCT batch_id, pos, text FROM pairs) GROUP BY batch_id),
    p AS (SELECT batch_id, to_json(list(aspect ORDER BY pos, k))::VARCHAR AS asp, count(*) AS n FROM pairs
      GROUP BY batch_id)
    SELECT batch_id, n AS expected_n, 'Given these sentences "' || ts || '" and aspect term pairs"' || asp ||
    '" which are of length ' || n || ', ' || {ASK_PAIRS} AS prompt FROM t JOIN p USING (batch_id)""",
)
def prompt_batch_labels(spark, sf):
    held = _batched(spark, sf).withColumn("aspects", X.contained("text", C.ASPECTS))
    return J.prompt_batch_labels(S.explode_aspects(held)).select(
        "batch_id", F.col("expected_n").cast("bigint").alias("expected_n"), "prompt"
    )


@query(
    "prompt_dataset",
    f"""WITH l AS (SELECT doc_id, {C.sql_truncate('text')} AS line, source,
      CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label_text FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, zero_shot, 'Given the sentence "' || line || '", ' || CASE WHEN zero_shot THEN
      'what is the sentiment polarity towards ' || source || '?'
      ELSE 'the sentiment polarity towards ' || source || ' is [mask]' END AS prompt, label_text
    FROM l CROSS JOIN (VALUES (TRUE), (FALSE)) z(zero_shot)""",
)
def prompt_dataset(spark, sf):
    rows = _texts(spark, sf).join(C.table(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        "text",
        F.col("source").alias("target"),
        F.when(F.col("quality") == 1, 0).otherwise(1).alias("label"),
    )
    parts = [
        H.prompt_dataset(rows, z).select("doc_id", F.lit(z).alias("zero_shot"), "prompt", "label_text")
        for z in (True, False)
    ]
    return parts[0].unionByName(parts[1])


# Model answers by rule: a correct array in double or single quotes, an array
# followed by words, or something that is not JSON.
def _response():
    held = X.contained("text", C.ASPECTS)
    double = F.concat(
        F.lit("Sure:\n["),
        F.array_join(F.transform(held, lambda a: F.concat(F.lit('{"aspectTerm": "'), a, F.lit('"}'))), ", "),
        F.lit("] \n"),
    )
    single = F.concat(
        F.lit("["),
        F.array_join(F.transform(held, lambda a: F.concat(F.lit("{'aspectTerm': \"it's "), a, F.lit("\"}"))), ", "),
        F.lit("]"),
    )
    return (
        F.when(F.col("lang") == "en", double)
        .when(F.col("lang") == "de", single)
        .when(F.col("lang") == "fr", F.concat(single, F.lit(" trailing")))
        .otherwise(F.lit("[oops]"))
    )


@query(
    "parse_response",
    f"""WITH h AS (SELECT doc_id, lang, {C.SQL_HELD} AS held FROM documents)
    SELECT doc_id, CASE WHEN lang = 'fr' THEN 'no array' WHEN lang NOT IN ('en', 'de') THEN 'not json'
      WHEN len(held) = 0 THEN 'empty array' END AS reject_reason,
    CASE WHEN lang = 'en' THEN array_to_string(held, '|')
      WHEN lang = 'de' THEN array_to_string(list_transform(held, lambda a: 'it''s ' || a), '|') END AS terms FROM h""",
)
def parse_response(spark, sf):
    answers = _texts(spark, sf).select("doc_id", _response().alias("response"))
    return answers.select(
        "doc_id",
        R.reject_reason("response").alias("reject_reason"),
        C.joined(R.parse("response", R.ASPECT_ENTRY)["aspectTerm"], "|").alias("terms"),
    )


@query(
    "as_list",
    f"""SELECT doc_id, CASE WHEN len({C.SQL_HELD}) = 0 THEN 'NONE' ELSE array_to_string({C.SQL_HELD}, '|') END
    AS terms FROM documents""",
)
def as_list(spark, sf):
    held = X.contained("text", C.ASPECTS)
    value = F.when(F.array_size(held) == 0, K.NONE_ASPECT).when(
        F.array_size(held) == 1, F.get(held, F.lit(0))
    ).otherwise(F.to_json(held))
    return C.docs(spark, sf).select("doc_id", C.joined(R.as_list(value), "|").alias("terms"))


def _has(word: str):
    return F.max(F.contains("text", F.lit(word)))


@query(
    "check_response",
    f"""WITH {BATCHED}, b AS (SELECT batch_id, count(*) AS n, bool_or(contains(text, 'disgusting')) AS lost,
      bool_or(contains(text, 'idiot')) AS short, bool_or(contains(text, 'clown')) AS chatty FROM batched GROUP BY batch_id)
    SELECT batch_id, n AS expected_n,
      CASE WHEN lost OR (chatty AND NOT short) THEN NULL WHEN short THEN n - 1 ELSE n END AS actual_n,
      CASE WHEN lost THEN 'no answer' WHEN short THEN 'wrong length' WHEN chatty THEN 'no array' END AS reject_reason,
      NOT (lost OR short OR chatty) AS ok FROM b""",
)
def check_response(spark, sf):
    facts = _batched(spark, sf).groupBy("batch_id").agg(
        F.count("*").alias("expected_n"),
        _has("disgusting").alias("lost"),
        _has("idiot").alias("short"),
        _has("clown").alias("chatty"),
    )
    n = F.when(F.col("short"), F.col("expected_n") - 1).otherwise(F.col("expected_n")).cast("int")
    body = F.concat(
        F.lit("["), F.array_join(F.array_repeat(F.lit("{'aspectTerm': 'NONE'}"), n), ","), F.lit("]")
    )
    answers = facts.where(~F.col("lost")).select(
        "batch_id",
        F.when(F.col("chatty") & ~F.col("short"), F.concat(body, F.lit(" Done."))).otherwise(body).alias("response"),
    )
    return J.check_response(facts.select("batch_id", "expected_n"), answers)


@query(
    "parse_bool",
    """SELECT event_id, CASE event_type WHEN 'click' THEN TRUE WHEN 'view' THEN FALSE WHEN 'signup' THEN TRUE
    WHEN 'error' THEN NULL ELSE TRUE END AS flag, CASE WHEN event_type = 'error' THEN 'not a boolean: maybe' END
    AS reject_reason FROM events""",
)
def parse_bool(spark, sf):
    kind = F.col("event_type")
    spelled = (
        F.when(kind == "click", "True").when(kind == "view", "off").when(kind == "signup", "Y")
        .when(kind == "error", "maybe").otherwise("1")
    )
    return C.table(spark, sf, "events").select(
        "event_id", R.parse_bool(spelled).alias("flag"), R.bool_reject(spelled).alias("reject_reason")
    )


@query(
    "one_line",
    f"SELECT conv_id, turn, {C.sql_strip(chr(39).join(['replace(text, chr(10), ', ' ', ')']))} AS line FROM conversations",
)
def one_line(spark, sf):
    return C.table(spark, sf, "conversations").select("conv_id", "turn", X.one_line("text").alias("line"))


# Reasoning inputs from conversations: every user turn is a sentence, the four
# assistant turns after it are the answers of its hops; a conversation that ends
# before leaves answers out.
def reasoning_inputs(spark, sf):
    turns = C.table(spark, sf, "conversations")
    n = F.length("text")
    rows = turns.where(F.col("role") == "user").select(
        F.struct("conv_id", "turn").alias("row_id"),
        "text",
        F.concat(F.lit(" conversation "), F.col("conv_id").cast("string"), F.lit(" <pad>")).alias("target"),
        F.when(n > 300, 0).when(n > 100, 1).otherwise(2).alias("label"),
        F.contains("text", F.lit("\n")).cast("int").alias("implicit"),
    )
    said = turns.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    size = F.length("text")
    verdict = F.when(size > 700, "It is Negative.").when(size > 300, "</s>neutral<pad>").otherwise("positive")
    gaps = F.explode(F.array(*[F.lit(g) for g in (1, 3, 5, 7)]))
    answers = said.select("conv_id", "turn", "text", gaps.alias("gap")).select(
        F.struct("conv_id", (F.col("turn") - F.col("gap")).alias("turn")).alias("row_id"),
        ((F.col("gap") + 1) / 2).cast("int").alias("hop"),
        F.when(F.col("gap") == 7, verdict).otherwise(F.col("text")).alias("answer"),
    )
    return rows, answers


def numbered(df):
    """The number that the results show; rows meet by conversation and turn."""
    return df.withColumn("row_id", F.col("row_id.conv_id") * 1000 + F.col("row_id.turn"))


def _clean(text: str, style: str) -> str:
    """Framed: pad marks and both ends go.  Chat: line feeds first."""
    if style == "chat":
        text = C.sql_strip(f"replace({text}, chr(10), ' ')")
    return C.sql_strip(f"replace(replace({text}, '<pad>', ''), '</s>', '')")


def _sql_reason(style: str) -> str:
    return f"""rws AS (SELECT conv_id * 1000 + turn AS row_id, conv_id, turn, text, ' conversation ' || conv_id || ' <pad>' AS target,
    CASE WHEN length(text) > 300 THEN 0 WHEN length(text) > 100 THEN 1 ELSE 2 END AS label,
    CAST(contains(text, chr(10)) AS INTEGER) AS implicit FROM conversations WHERE role = 'user'),
  said AS (SELECT row_id, (s.turn - r.turn + 1) // 2 AS hop, s.text AS t FROM rws r JOIN conversations s USING (conv_id)
    WHERE s.role = 'assistant' AND s.turn - r.turn IN (1, 3, 5, 7)),
  ans AS (SELECT row_id, hop, {_clean('a', style)} AS answer FROM (SELECT row_id, hop, CASE WHEN hop < 4 THEN t
    WHEN length(t) > 700 THEN 'It is Negative.' WHEN length(t) > 300 THEN '</s>neutral<pad>' ELSE 'positive' END AS a FROM said)),
  a AS (SELECT row_id, max(answer) FILTER (WHERE hop = 1) AS answer_1, max(answer) FILTER (WHERE hop = 2) AS answer_2,
    max(answer) FILTER (WHERE hop = 3) AS answer_3, max(answer) FILTER (WHERE hop = 4) AS answer_4 FROM ans GROUP BY row_id),
  j AS (SELECT *, 'Given the sentence "' || text || '", ' AS c1, {_clean('target', 'framed') if style == 'framed' else 'target'} AS t
    FROM rws LEFT JOIN a USING (row_id))"""


def _sql_hops(style: str) -> str:
    framed = style == "framed"
    kept = lambda c: _clean(c, "framed") if framed else c
    c2 = (
        f"{kept('c1')} || ' The mentioned aspect is about ' || answer_1 || '.'" if framed else "c1 || ' ' || answer_1"
    )
    c3 = (
        f"{kept('c2')} || ' The opinion towards the mentioned aspect of ' || t || ' is ' || answer_2 || '.'"
        if framed
        else "c2 || ' ' || answer_2"
    )
    p4 = (
        f"{kept('c3')} || ' The sentiment polarity is ' || answer_3 || '.' || {FRAMED_LABEL}"
        if framed
        else f"answer_3 || {CHAT_LABEL}"
    )
    code = C.sql_exact("answer_4") if framed else C.sql_contains("answer_4")
    return f"""{_sql_reason(style)}, s2 AS (SELECT *, {c2} AS c2 FROM j), s3 AS (SELECT *, {c3} AS c3 FROM s2),
  hops AS (SELECT row_id, text, target, label, implicit,
    c1 || 'which specific aspect of ' || target || ' is possibly mentioned?' AS prompt_1, answer_1,
    c2 || ' Based on the common sense, what is the implicit opinion towards the mentioned aspect of ' || t ||
      ', and why?' AS prompt_2, answer_2,
    c3 || ' Based on such opinion, what is the sentiment polarity towards ' || t || '?' AS prompt_3, answer_3,
    {p4} AS prompt_4, answer_4, CASE WHEN answer_4 IS NOT NULL THEN {code} END AS predicted,
    CASE WHEN answer_1 IS NULL THEN 'no answer to hop 1' WHEN answer_2 IS NULL THEN 'no answer to hop 2'
      WHEN answer_3 IS NULL THEN 'no answer to hop 3' WHEN answer_4 IS NULL THEN 'no answer to hop 4' END AS reject_reason
    FROM s3)"""


HOP_COLUMNS = (
    "row_id", "target", "label", "implicit", "prompt_1", "answer_1", "prompt_2", "answer_2",
    "prompt_3", "answer_3", "prompt_4", "answer_4", "predicted", "reject_reason",
)


@query(
    "next_hop",
    f"""WITH {_sql_reason('framed')}, c AS (SELECT *, {_clean('c1', 'framed')} || ' The mentioned aspect is about ' || answer_1 || '.'
      AS context FROM j)
    SELECT row_id, context, answer_1, context || ' Based on the common sense, what is the implicit '
    || 'opinion towards the mentioned aspect of ' || t || ', and why?' AS prompt_2 FROM c""",
)
def next_hop(spark, sf):
    rows, answers = reasoning_inputs(spark, sf)
    return numbered(H.next_hop(H.first_hop(rows), answers, 1)).select("row_id", "context", "answer_1", "prompt_2")


@query("reason_three_hop", f"WITH {_sql_hops('framed')} SELECT {', '.join(HOP_COLUMNS)} FROM hops")
def reason_three_hop(spark, sf):
    return numbered(H.reason(*reasoning_inputs(spark, sf))).select(*HOP_COLUMNS)


@query("reason_chat", f"WITH {_sql_hops('chat')} SELECT {', '.join(HOP_COLUMNS)} FROM hops")
def reason_chat(spark, sf):
    return numbered(H.reason(*reasoning_inputs(spark, sf), style="chat")).select(*HOP_COLUMNS)


@query(
    "conversation",
    f"""WITH {_sql_hops('chat')}, m AS (SELECT row_id, ['Now you are an expert of sentiment and opinion analysis.', prompt_1,
      answer_1, prompt_2, answer_2, prompt_3, answer_3, prompt_4, answer_4] AS texts FROM hops),
    t AS (SELECT row_id, unnest(texts) AS text, CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS turn FROM m)
    SELECT row_id, turn, CASE WHEN turn = 0 THEN 'system' WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, text
    FROM t WHERE text IS NOT NULL""",
)
def conversation(spark, sf):
    return numbered(H.conversation(H.reason(*reasoning_inputs(spark, sf), style="chat")))


NAMES = "['positive', 'negative', 'neutral']"


@query(
    "trace_fields",
    f"""WITH {_sql_hops('chat')} SELECT {C.sql_strip("regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')")} AS sentence, {C.sql_strip('target')} AS target,
    {NAMES}[label + 1] AS gold, implicit, coalesce({NAMES}[predicted + 1], 'none') AS predicted,
    CASE WHEN predicted IS NULL THEN 'unknown label' END AS reject_reason FROM hops""",
)
def trace_fields(spark, sf):
    records = H.trace_records(H.reason(*reasoning_inputs(spark, sf), style="chat"))
    return records.select(R.trace_fields("record").alias("f"), R.trace_reject("record").alias("reject_reason")).select(
        "f.*", "reject_reason"
    )


SCORE = (
    "round(100.0::DOUBLE * count(*) FILTER (WHERE gold = pred) / count(*), 3) AS \"Acc_SA\", "
    + C.sql_macro() + ' AS "F1_SA", ' + C.sql_macro("implicit = 0") + ' AS "F1_ESA", '
    + C.sql_macro("implicit = 1") + ' AS "F1_ISA", ' + C.sql_macro() + ' AS "default"'
)


@query(
    "evaluate_trace",
    f"""WITH {_sql_hops('chat')}, s AS (SELECT label AS gold, predicted AS pred, implicit FROM hops WHERE predicted IS NOT NULL)
    SELECT {SCORE}, 'test' AS mode FROM s""",
)
def evaluate_trace(spark, sf):
    records = H.trace_records(H.reason(*reasoning_inputs(spark, sf), style="chat"))
    trace = records.select(R.trace_fields("record").alias("f"), R.trace_reject("record").alias("reject_reason"))
    return E.evaluate_trace(trace.select("f.*", "reject_reason"))


def _histories(spark, sf):
    out = H.dialog_history(C.table(spark, sf, "conversations"))
    said = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return out.select("conv_id", "turn", C.joined(said, C.SEP).alias("history"))


@query(
    "dialog_history",
    """SELECT conv_id, turn, string_agg(role || ': ' || text, chr(31))
    OVER (PARTITION BY conv_id ORDER BY turn) AS history FROM conversations""",
)
def dialog_history(spark, sf):
    return _histories(spark, sf)


@query(
    "dialog_history_whole",
    """SELECT conv_id, max(turn) AS turn, string_agg(role || ': ' || text, chr(31) ORDER BY turn) AS history
    FROM conversations GROUP BY conv_id""",
)
def dialog_history_whole(spark, sf):
    """What a conversation's last turn has before it."""
    last = F.max(F.struct("turn", "history"))
    return _histories(spark, sf).groupBy("conv_id").agg(last.alias("m")).select("conv_id", "m.turn", "m.history")


SQL_INFER = """SELECT doc_id, CASE WHEN contains(text, 'idiot') OR contains(text, 'stupid') THEN 'negative'
    WHEN contains(text, 'best') THEN 'positive' ELSE 'neutral' END AS answer FROM documents"""


def _stand_in(prompts: list[str]) -> list[str]:
    """In place of a model: the same answer for the same prompt."""
    return [
        "negative" if "idiot" in p or "stupid" in p else "positive" if "best" in p else "neutral"
        for p in prompts
    ]


@query("infer", SQL_INFER)
def infer(spark, sf):
    return run_model(_pair(_texts(spark, sf), P.direct("text", "source")), _stand_in, "doc_id")


@query("infer_stored", SQL_INFER)
def infer_stored(spark, sf):
    """The labelled documents first, then all: what was asked is not asked again."""
    path = C.scratch(spark)
    prompts = _pair(_texts(spark, sf), P.direct("text", "source"))
    ask_once(prompts.join(C.table(spark, sf, "labels"), "doc_id", "left_semi"), lambda: _stand_in, "doc_id", path, "stand-in")
    return ask_once(prompts, lambda: _stand_in, "doc_id", path, "stand-in", parts=2)
