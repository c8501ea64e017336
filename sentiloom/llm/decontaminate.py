"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items form one automaton.  Each text is scanned
once, and every hit is mapped back to words and to places in the original.
"""

from __future__ import annotations

from functools import lru_cache
from uuid import uuid4

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import computed, quoted

WINDOW = 10
#: Benchmarks are broadcast up to so many bytes of normalised text.
MOST_BYTES = 256 << 20

# A-Z become a-z; other ASCII that is no digit and no letter parts words.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict[str, list[str]]:
    """Each window, blanks around every word, with the items it occurs in."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            window = b" " + b" ".join(words[i : i + size]) + b" "
            found.setdefault(window.decode("latin-1"), set()).add(item)
    return {w: sorted(x) for w, x in found.items()}


def automaton_of(windows: dict[str, list[str]]) -> ahocorasick.Automaton:
    """Over single-byte characters, so that a place in a text is a byte."""
    automaton = ahocorasick.Automaton()
    for k, (window, items) in enumerate(windows.items()):
        automaton.add_word(window, (k, len(window), items))
    automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """Words, words hit, items met, and the hit passages as code points of the text."""
    raw = (text or "").encode()
    plain = raw.translate(_NORMAL)
    words = plain.split()
    if not words or not len(automaton):
        return len(words), 0, [], []
    joined = b" " + b" ".join(words) + b" "
    met, ends = {}, []
    for end, (k, length, items) in automaton.iter(joined.decode("latin-1")):
        met[k] = items
        ends.append((end - length + 1, end))
    if not met:
        return len(words), 0, [], []
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    at = np.searchsorted(blanks, np.array(ends))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at[:, 0], 1)
    np.add.at(step, at[:, 1], -1)
    hit = np.cumsum(step)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    first, last = edges[::2], edges[1::2] - 1
    letters = np.frombuffer(b" " + plain + b" ", np.uint8) != 32
    turn = np.flatnonzero(letters[1:] != letters[:-1])
    point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    point = np.concatenate(([0], point))
    spans = [(int(point[turn[2 * a]]), int(point[turn[2 * b + 1]])) for a, b in zip(first, last)]
    return len(words), int(hit.sum()), sorted({i for x in met.values() for i in x}), spans


@lru_cache(maxsize=2)
def _built(token: str, broadcast):
    return automaton_of(broadcast.value)


class _Known:
    """A broadcast whose identity is a token, so that a worker builds its automaton once."""

    def __init__(self, broadcast):
        self.broadcast, self.token = broadcast, uuid4().hex

    def __hash__(self):
        return hash(self.token)

    def __eq__(self, other):
        return self.token == other.token

    @property
    def value(self):
        return self.broadcast.value


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """How much of each text occurs in a benchmark.

    Returns ``row`` (the whole input row), ``n_words``, ``n_hit`` (words inside
    any window), ``n_items``, ``items`` (their ids as text, sorted) and
    ``spans`` (hit passages, code points of the original text).  A null or
    empty text has no words; an item without words has no window; repeated
    items count once by id; an item whose id is null is left out; repeated
    rows are judged alike; an empty benchmark hits nothing.  The benchmark is
    measured before it is broadcast; one beyond ``most_bytes`` is refused, as
    one automaton would not fit a worker: split it and scan once per part.
    """
    items = benchmark.select(
        quoted(item_id).cast("string").alias("item"), quoted(item_text).alias("text")
    ).where("item IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes, more than {most_bytes}")
    known = windows_of([tuple(r) for r in items.collect()], window)
    shared = _Known(df.sparkSession.sparkContext.broadcast(known))

    def compute(texts):
        automaton = _built(shared.token, shared)
        found = [scan(t, automaton) for t in texts]
        return (
            [x[0] for x in found],
            [x[1] for x in found],
            [len(x[2]) for x in found],
            [x[2] for x in found],
            [[{"start": a, "end": b} for a, b in x[3]] for x in found],
        )

    fields = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>"
    return computed(df, [text], fields, compute)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows without any hit, with their own columns."""
    return contamination(df, benchmark, text, **options).where("n_hit = 0").select("row.*")
