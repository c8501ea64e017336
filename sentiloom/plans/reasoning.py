"""Prompt tables and multi-hop reasoning over stored answers.

A hop is a join: the answer table of the previous hop, by row key, gives the
next context and prompt.  The model itself stays outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom import constants as K
from sentiloom.functions import prompts as P
from sentiloom.functions import responses as R
from sentiloom.functions import text as X

HOPS = ("aspect", "opinion", "polarity", "label")


def prompt_dataset(
    rows: DataFrame, zero_shot: bool, n_words: int = K.MAX_LENGTH - K.RESERVED_WORDS
) -> DataFrame:
    """One-step prompts of an evaluation split; needs text, target, label."""
    ask = P.direct if zero_shot else P.masked
    return (
        rows.withColumn("_line", X.truncate_words("text", n_words))
        .withColumn("prompt", ask(F.col("_line"), F.col("target"))[1])
        .withColumn("label_text", R.label_name("label"))
        .drop("_line")
    )


def first_hop(rows: DataFrame, n_words: int | None = None) -> DataFrame:
    """Context and prompt of the first hop; needs text and target."""
    line = F.col("text") if n_words is None else X.truncate_words("text", n_words)
    context, prompt = P.aspect(line, F.col("target"))
    return rows.withColumn("context", context).withColumn("prompt_1", prompt)


def clean_answer(style: str) -> Column:
    """Pad marks and both ends go; only a chat puts an answer on one line."""
    return R.strip_specials("answer" if style == "framed" else X.one_line("answer"))


def _carried(style: str, name: str) -> Column:
    """What the framed style carries from hop to hop loses pad marks and both ends."""
    return R.strip_specials(name) if style == "framed" else F.col(name)


def next_hop(
    rows: DataFrame, answers: DataFrame, hop: int, key: str = "row_id", style: str = "framed"
) -> DataFrame:
    """Add answer ``hop`` and the prompt after it; a missing answer leaves NULL.

    ``answers`` has ``(key, hop, answer)``.
    """
    name = f"answer_{hop}"
    given = answers.where(F.col("hop") == hop).select(key, clean_answer(style).alias(name))
    joined = rows.join(given, key, "left")
    context, target = _carried(style, "context"), _carried(style, "target")
    if hop == 1:
        context, prompt = P.opinion(context, target, name, style)
    elif hop == 2:
        context, prompt = P.polarity(context, target, name, style)
    elif hop == 3:
        prompt = P.label(context, name, style)
    else:
        return joined
    return joined.withColumn(f"prompt_{hop + 1}", prompt).withColumn("context", context)


def pivot_answers(answers: DataFrame, key: str = "row_id", style: str = "framed") -> DataFrame:
    """Answers of all hops side by side, so that one join attaches them."""
    clean = clean_answer(style)
    return answers.groupBy(key).agg(
        *[
            F.max(F.when(F.col("hop") == h, clean)).alias(f"answer_{h}")
            for h in range(1, len(HOPS) + 1)
        ]
    )


def reason(
    rows: DataFrame,
    answers: DataFrame,
    key: str = "row_id",
    style: str = "framed",
    n_words: int | None = None,
) -> DataFrame:
    """Three hops and the label, every prompt and answer kept.

    With all answers stored, one join serves every hop.  ``predicted`` follows
    the decoder that belongs to the style.  Without a label answer it is NULL,
    and ``reject_reason`` names the first answer that is missing.
    """
    out = first_hop(rows, n_words).join(pivot_answers(answers, key, style), key, "left")
    context, target = _carried(style, "context"), _carried(style, "target")
    carried, prompt = P.opinion(context, target, "answer_1", style)
    out = out.withColumn("prompt_2", prompt).withColumn("context", carried)
    carried, prompt = P.polarity(context, target, "answer_2", style)
    out = out.withColumn("prompt_3", prompt).withColumn("context", carried)
    out = out.withColumn("prompt_4", P.label(context, "answer_3", style))
    decode = R.decode_exact if style == "framed" else R.decode_contains
    missing = F.coalesce(
        *[F.when(F.col(f"answer_{h}").isNull(), F.lit(f"no answer to hop {h}")) for h in range(1, len(HOPS) + 1)]
    )
    return out.withColumn("predicted", F.when(F.col("answer_4").isNotNull(), decode("answer_4"))).withColumn(
        "reject_reason", missing
    )


def trace_records(reasoned: DataFrame) -> DataFrame:
    """Ten-line records of a reasoned table with label and implicit columns.

    The label's answer is stored in lower case.  A record is made once, however
    many conditions and fields read it: expressions are not copied through a
    generator, as they are through a projection.
    """
    steps = [F.col(f"{kind}_{h}") for h in range(1, 5) for kind in ("prompt", "answer")]
    steps[-1] = F.lower(steps[-1])
    record = R.trace_record(
        "text",
        "target",
        R.label_name("label"),
        F.col("implicit").cast("int"),
        steps,
        R.label_name("predicted"),
    )
    return reasoned.select(F.explode(F.array(record)).alias("record"))


def conversation(reasoned: DataFrame, key: str = "row_id") -> DataFrame:
    """The chat behind each reasoned row: system line, then prompt and answer by turns."""
    said = [("system", F.lit(K.CHAT_SYSTEM))]
    for hop in range(1, len(HOPS) + 1):
        said += [("user", F.col(f"prompt_{hop}")), ("assistant", F.col(f"answer_{hop}"))]
    messages = F.array(*[F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in said])
    return (
        reasoned.select(key, F.posexplode(messages).alias("turn", "_m"))
        .select(key, "turn", "_m.role", "_m.text")
        .where(F.col("text").isNotNull())
    )


def dialog_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages up to and including each turn, all of them.

    A conversation becomes one ordered array, and each turn gets the slice up
    to itself; the result is as long as the histories together.
    """
    said = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", "text")))
    whole = turns.groupBy(conv).agg(said.alias("said")).select(conv, "said", F.posexplode("said").alias("pos", "now"))
    heard = F.transform(
        F.slice("said", F.lit(1), F.col("pos") + 1), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))
    )
    return whole.select(conv, F.col("now.turn").alias(turn), heard.alias("history"))
