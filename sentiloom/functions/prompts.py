"""Prompt wording as Column expressions.

Every function returns ``(context, prompt)``; the context of one step is the
input of the next.  ``style`` is "framed" (the answer is put into a sentence)
or "chat" (the answer is appended as it is).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentiloom import constants as K
from sentiloom.functions.text import col

STYLES = ("framed", "chat")


def fill(template: str, **values: Column | str) -> Column:
    """Replace ``{name}`` in a fixed text by columns; one ``concat``, no UDF."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[
            col(values[p]) if i % 2 else F.lit(p)
            for i, p in enumerate(parts)
            if i % 2 or p
        ]
    )


def _check(style: str) -> bool:
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    return style == "framed"


def opening(context: Column | str) -> Column:
    return fill(K.CONTEXT_OPENING, context=context)


def _ask(context: Column | str, question: str, **values) -> tuple[Column, Column]:
    start = opening(context)
    return start, F.concat(start, fill(question, **values))


def direct(context, target):
    return _ask(context, K.ASK_POLARITY, target=target)


def masked(context, target):
    return _ask(context, K.ASK_POLARITY_MASKED, target=target)


def aspect(context, target):
    return _ask(context, K.ASK_ASPECT, target=target)


def opinion(context, target, answer, style: str = "framed"):
    glue = K.FRAMED_ASPECT if _check(style) else " {answer}"
    new = F.concat(col(context), fill(glue, answer=answer))
    return new, F.concat(new, fill(K.ASK_OPINION, target=target))


def polarity(context, target, answer, style: str = "framed"):
    glue = K.FRAMED_OPINION if _check(style) else " {answer}"
    new = F.concat(col(context), fill(glue, target=target, answer=answer))
    return new, F.concat(new, fill(K.ASK_POLARITY_OF_OPINION, target=target))


def label(context, answer, style: str = "framed") -> Column:
    if _check(style):
        return F.concat(
            col(context), fill(K.FRAMED_POLARITY, answer=answer), F.lit(K.FRAMED_LABEL)
        )
    return F.concat(col(answer), F.lit(K.CHAT_LABEL))


def targets(context):
    """Ad-hoc inference: which targets does the sentence speak about?"""
    return _ask(context, K.ASK_TARGETS)


def opinion_expression(context, target):
    """Ad-hoc inference: the opinion expression of a target."""
    return _ask(context, K.ASK_OPINION_EXPRESSION, target=target)


def aspect_terms(context):
    """Single-sentence form of the aspect request."""
    return _ask(context, K.ASK_ASPECT_TERMS)


def pair_labels(sentence, aspects) -> Column:
    """Single-sentence form of the polarity and implicitness request."""
    return F.concat(
        fill(K.SENTENCE_PAIR_OPENING, sentence=sentence, aspects=aspects),
        F.lit(K.ASK_PAIR_LABELS),
    )


def batch_aspects(sentences: Column) -> Column:
    """Aspect request for a JSON list of sentences."""
    return F.concat(fill(K.BATCH_OPENING, sentences=sentences), F.lit(K.ASK_ASPECT_TERMS))


def batch_labels(sentences: Column, aspects: Column, n: Column) -> Column:
    """Polarity and implicitness request for JSON lists of sentences and aspects."""
    return F.concat(
        fill(K.BATCH_PAIRS_OPENING, sentences=sentences, aspects=aspects, n=n.cast("string")),
        F.lit(K.ASK_PAIR_LABELS),
    )
