"""Credentials by pattern, and strings that inferred grammars take for credentials.

What the patterns find are the labelled credentials.  From them one automaton
per kind is inferred, and three from other tokens of the same alphabet: those
with a digit, those without lower-case letters, and words.  Every token is then
scored by the odds that its format came from a credential.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import computed, quoted, store
from sentiloom.llm.grammars import Automaton, infer

KINDS = ("assign", "access", "hex")
WORD = len(KINDS)
CAPITALS, NUMBER = WORD + 1, WORD + 2
#: Each with the group that is the credential and its fewest characters.
PATTERNS = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    (re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a shorter run would fail its check, and no run is cut
)
#: A token of eight characters or more; punctuation at its ends is left out, padding is not.
DIGIT = re.compile("[0-9]")
CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.-]{6,}[A-Za-z0-9]={0,2}")
#: Automata are fitted on so many different strings of a kind at most, those with
#: the smallest hashes, of at most so many characters.  Scores cover all tokens.
SAMPLE, SAMPLE_LENGTH = 4000, 256
#: Kinds with fewer different credentials have no automaton.
SUPPORT = 20


def base(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind, start, end, credential)`` of each match that passes, by start, then kind."""
    found = []
    for kind, (pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end(), m[group]))
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, known: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """``(start, end, token)`` of the tokens that touch no base span."""
    found, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while i < len(known) and known[i][1] < m.end():
            reach = max(reach, known[i][2])
            i += 1
        if reach <= m.start():
            found.append((m.start(), m.end(), m[0]))
    return found


def _tokens(text: str, known: list) -> list[str]:
    return [t for _, _, t in candidates(text, known)] if known else CANDIDATE.findall(text)


class Sketch:
    """The different strings with the smallest hashes, with their exact counts, and the total."""

    def __init__(self, size: int):
        self.size, self.total, self.counts, self.marks, self.bound = size, 0, Counter(), {}, 1 << 64

    def add(self, string: str, n: int) -> None:
        self.total += n
        if string not in self.marks:
            mark = xxhash.xxh64_intdigest(string)
            if mark >= self.bound or len(string) > SAMPLE_LENGTH:
                return
            self.marks[string] = mark
        self.counts[string] += n
        if len(self.marks) > 2 * self.size:
            least = sorted(self.marks, key=lambda s: (self.marks[s], s))[: self.size]
            self.bound = self.marks[least[-1]] + 1
            self.marks = {s: self.marks[s] for s in least}
            self.counts = Counter({s: self.counts[s] for s in least})


def gathered(df: DataFrame, text: str, size: int) -> DataFrame:
    """``(kind, token, mark, n)``: what sketches of all texts kept; a null token has its kind's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Sketch(size) for _ in range(NUMBER + 1)]
        for batch in batches:
            for value in batch.column(0).to_pylist():
                value = value or ""
                known = base(value)
                for kind, _, _, credential in known:
                    sketches[kind].add(credential, 1)
                for token, n in Counter(_tokens(value, known)).items():
                    sketches[NUMBER if DIGIT.search(token) else CAPITALS if token == token.upper() else WORD].add(token, n)
        for kind, s in enumerate(sketches):
            tokens = [None, *s.counts]
            marks = [0, *(s.marks[t] - (1 << 63) for t in s.counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(tokens), pa.int32()),
                    pa.array(tokens, pa.string()),
                    pa.array(marks, pa.int64()),
                    pa.array([s.total, *s.counts.values()], pa.int64()),
                ],
                names=["kind", "token", "mark", "n"],
            )

    rows = df.select(quoted(text).cast("string")).mapInArrow(run, "kind int, token string, mark long, n long")
    return store(rows.groupBy("kind", "token", "mark").agg(F.sum("n").alias("n")), "credentials")


@dataclass
class Model:
    kinds: list[int]  # from WORD on they are no credentials
    automata: list[Automaton]
    seen: list[int]  # tokens of each kind in the whole table

    def odds(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest kind of each token, and the log odds that it is a credential."""
        each = np.stack([a.likelihoods(tokens) + np.log(n) for a, n in zip(self.automata, self.seen)])
        own = sum(k < WORD for k in self.kinds)
        best = each[:own].argmax(axis=0)
        total = [np.logaddexp.reduce(part, axis=0) for part in (each[:own], each[own:])]
        return np.array(self.kinds)[best], total[0] - total[1]


def least(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest marks, cut by executors: the filter keeps the cut from the driver."""
    return rows.orderBy("mark", "token").limit(n).where("token IS NOT NULL")


def fit(df: DataFrame, text: str = "text", sample: int = SAMPLE, alpha: float = 0.05) -> Model | None:
    """Automata from what the patterns find and from other tokens; ``None`` without enough of them.

    Totals count every token of every text.  The driver gets ``sample`` strings
    a kind: of all different ones those with the smallest hashes.
    """
    stored = gathered(df, text, sample)
    totals = {r["kind"]: r["n"] for r in stored.where("token IS NULL").collect()}
    strings = [
        [r["token"] for r in least(stored.where((F.col("kind") == k) & F.col("token").isNotNull()), sample).collect()]
        for k in range(NUMBER + 1)
    ]
    kinds = [k for k in range(NUMBER + 1) if len(strings[k]) >= (SUPPORT if k < WORD else 1)]
    if not kinds or kinds[0] >= WORD or kinds[-1] < WORD:
        return None
    return Model(kinds, [infer(strings[k], alpha) for k in kinds], [totals[k] for k in kinds])


def found(text: str, known: list, score: dict[str, tuple[int, float]]) -> list[tuple[int, int, int, float]]:
    """``(kind, start, end, score)`` of the candidates that are scored as credentials."""
    return [(score[t][0], a, b, score[t][1]) for a, b, t in candidates(text, known) if t in score]


def find(df: DataFrame, text: str = "text", least: float = 0.99999, model: Model | None = None) -> DataFrame:
    """Each row as ``row``, its ``base`` spans and the ``found`` ones.

    ``base`` are ``(kind, start, end)`` in code points, ends exclusive, by start,
    then kind; of each kind leftmost matches that do not overlap, less those
    that fail their check.  ``found`` are tokens beside them, with a ``score``
    of at least ``least``: the probability that the token is a credential, from
    its likelihood under its kind's automaton and that of other tokens, and
    how many tokens of both the whole table has.

    A null text counts as empty and has no spans.  Texts of any length are
    scanned whole; tokens beyond ``SAMPLE_LENGTH`` are scored but train nothing.
    Equal rows get equal spans.  A table with too few credentials, or none, has
    base spans only; an empty table gives no rows.
    """
    model = fit(df, text) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast(model)
    bar = float(np.log(least / (1 - least)))

    def run(texts: list[str | None]):
        texts = [t or "" for t in texts]
        known = [base(t) for t in texts]
        score, own = {}, shared.value
        tokens = sorted({x for t, k in zip(texts, known) for x in _tokens(t, k)}) if own else []
        for i in range(0, len(tokens), 4096):
            part = tokens[i : i + 4096]
            kinds, odds = own.odds(part)
            score |= {
                part[j]: (int(kinds[j]), float(1 / (1 + np.exp(-min(odds[j], 700.0))))) for j in np.flatnonzero(odds >= bar)
            }
        more = [found(t, k, score) if score else [] for t, k in zip(texts, known)]
        return (
            [[{"kind": k, "start": a, "end": b} for k, a, b, _ in spans] for spans in known],
            [[{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in spans] for spans in more],
        )

    fields = "base array<struct<kind:int,start:int,end:int>>, found array<struct<kind:int,start:int,end:int,score:double>>"
    return computed(df, [text], fields, run)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span by start, then kind, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
