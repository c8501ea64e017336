"""Terms that occur anywhere in a text, for a list of terms that every task holds.

Texts stay in their row.  The eight bytes at each place of a text are one
number, so that many places are compared with all terms at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 8
# Places of texts looked at in one go, bits of the table that sorts out most of them.
PLACES, BITS = 1 << 19, 20


def _masks(sizes: np.ndarray) -> np.ndarray:
    """Numbers that keep the first ``sizes`` (0 to 8) bytes of a word."""
    keep = [0, *((1 << (8 * n)) - 1 for n in range(1, WORD + 1))]
    return np.array(keep, np.uint64)[np.clip(sizes, 0, WORD)]


def _slots(words: np.ndarray) -> np.ndarray:
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


class Terms:
    """Different terms by their first word, and what follows it."""

    def __init__(self, terms: Sequence[bytes]):
        sizes = np.array([len(t) for t in terms], np.int64)
        self.sizes, self.steps = sizes, -(-int(sizes.max()) // WORD)
        self.by_size = []
        heads = np.array([int.from_bytes(t[:WORD], "little") for t in terms], np.uint64)
        for n in range(1, WORD + 1):
            own = np.flatnonzero(np.minimum(sizes, WORD) == n)
            if not len(own):
                continue
            own = own[np.argsort(heads[own], kind="stable")]
            words, first, many = np.unique(heads[own], return_index=True, return_counts=True)
            may = np.zeros(1 << BITS, bool)
            may[_slots(words)] = True
            self.by_size.append((_masks(np.array([n]))[0], may, words, first, many, own))
        self.words = np.zeros((self.steps, len(terms)), np.uint64)
        for step in range(self.steps):
            self.words[step] = [int.from_bytes(t[step * WORD : (step + 1) * WORD], "little") for t in terms]

    def found(self, data: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
        """``row * terms + term`` for terms that begin at the places from ``low`` to ``high``."""
        reach = (self.steps + 1) * WORD
        near = np.zeros(high - low + reach, np.uint64)
        there = data[low : high + reach]
        near[: len(there)] = there
        at_all = near[: len(near) - WORD + 1].copy()
        for i in range(1, WORD):
            at_all |= near[i : len(near) - WORD + 1 + i] << np.uint64(8 * i)
        row = np.searchsorted(ends, np.arange(low, high), side="right")
        out = []
        for mask, may, words, first, many, own in self.by_size:
            here = at_all[: high - low] & mask
            place = np.flatnonzero(may[_slots(here)])
            at = np.minimum(np.searchsorted(words, here[place]), len(words) - 1)
            same = words[at] == here[place]
            place, at = place[same], at[same]
            count = many[at]
            term = own[np.repeat(first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            place = np.repeat(place, count)
            inside = place + low + self.sizes[term] <= ends[row[place]]
            place, term = place[inside], term[inside]
            for step in range(1, self.steps):
                if not len(term) or mask != np.uint64(0xFFFFFFFFFFFFFFFF):
                    break
                rest = at_all[place + step * WORD] & _masks(self.sizes[term] - step * WORD)
                same = rest == self.words[step][term]
                place, term = place[same], term[same]
            out.append(np.unique(row[place] * len(self.sizes) + term))
        return np.concatenate(out)


def terms_in(docs: DataFrame, terms: Sequence[str], key: str, text: str) -> DataFrame:
    """``(key, aspect)`` for each of the different ``terms``, none empty, that a text holds."""
    listed = [t.encode() for t in terms]
    out = T.StructType([docs.select(key).schema.fields[0], T.StructField("aspect", T.StringType())])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = Terms(listed), pa.array(terms, pa.string())
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if not len(texts) or bounds[-1] == bounds[0]:
                continue
            data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            ends, rest = bounds[1:] - bounds[0], np.empty(0, np.int64)
            for low in range(0, len(data), PLACES):
                high = min(low + PLACES, len(data))
                hits = np.union1d(rest, known.found(data, ends, low, high))
                # a text that goes on in the next places may hold a term there again
                open_row = np.searchsorted(ends, high, side="right") if high < len(data) else len(ends)
                done = np.searchsorted(hits, open_row * len(listed))
                row, term = np.divmod(hits[:done], len(listed))
                rest = hits[done:]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(term))], [key, "aspect"])

    return docs.select(key, F.col(text)).mapInArrow(held, out)
