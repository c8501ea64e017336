"""Language mixtures of documents by expectation-maximisation.

Every word is drawn from one of the document's languages.  Its likelihood in
each language comes from byte n-grams; the proportions of the languages are
estimated by expectation-maximisation, and the set of languages is the one of
best likelihood less a penalty for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import computed, in_slices, quoted, store

BUCKETS = 1 << 16
#: Models hold ``BUCKETS`` numbers a language and are broadcast; this many fit.
MOST_LANGUAGES = 256
#: Bytes of text that are looked at together; longer texts come in pieces.
SLICE = 1 << 20
UNDETERMINED = "und"

# Words are letters: a-z after lower-casing, and all that is not ASCII.
_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # by language and n-gram bucket


def _pieces(text: str) -> list[bytes]:
    """The words of a text as bytes, in pieces that end between words."""
    plain = text.lower().encode().translate(_WORDS)
    out, at = [], 0
    while len(plain) - at > SLICE:
        cut = plain.rfind(b" ", at, at + SLICE)
        cut = at + SLICE if cut <= at else cut
        out.append(plain[at:cut])
        at = cut
    return [*out, plain[at:]]


def _grams(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each letter the bucket of the four bytes around it, and where words start.

    Before the word and after it there is a blank; nothing of other words counts.
    """
    a = np.frombuffer(b"   " + plain + b"  ", np.uint8).astype(np.uint32)
    here = np.flatnonzero(a[2:-1] != 32) + 2
    before = a[here - 1]
    second = np.where(before == 32, 32, a[here - 2])
    code = (second << 24) | (before << 16) | (a[here] << 8) | a[here + 1]
    return (code * np.uint32(2654435761)) >> 16, np.flatnonzero(before == 32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def out():
        for lang, n in counts.items():
            seen = np.flatnonzero(n)
            columns = [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            if lang not in counts and len(counts) >= 64:
                yield from out()
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for part in in_slices(own, len, SLICE):
                for piece in _pieces(" ".join(part)):
                    total += np.bincount(_grams(piece)[0], minlength=BUCKETS)
    yield from out()


def fit(df: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = MOST_LANGUAGES) -> Model:
    """Count the n-grams of each language over all rows with a text and a language.

    Counts are summed in each task before they move.  The model has
    ``BUCKETS`` numbers a language, whatever the corpus; more than
    ``most_languages`` languages are refused.  No rows give a model without
    languages.
    """
    rows = df.select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text")).dropna()
    found = rows.mapInArrow(_train, "lang string, bucket int, n long")
    counts = store(found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    languages = [r[0] for r in counts.select("lang").distinct().limit(most_languages + 1).collect()]
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages.sort()
    n = np.full((len(languages), BUCKETS), 0.5)
    if languages:
        got = counts.toArrow()
        at = {x: i for i, x in enumerate(languages)}
        which = np.array([at[x] for x in got.column("lang").to_pylist()], np.int64)
        n[which, got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    return Model(languages, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))


def _word_likelihoods(plain: bytes, table: np.ndarray) -> np.ndarray:
    """Log-likelihoods by language and word; ``table`` is by language and bucket."""
    grams, starts = _grams(plain)
    if not len(grams):
        return np.zeros((len(table), 0), np.float32)
    return np.stack([np.add.reduceat(row[grams], starts) for row in table])


def _mixture(likely: np.ndarray, first: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, rounds: int):
    """Proportions of the chosen languages, and the log-likelihood, for each document.

    ``likely`` is by language and word, relative to the word's best one;
    ``chosen`` and the proportions are by language and document.
    """
    share = (chosen / chosen.sum(axis=0)).astype(np.float32)
    for _ in range(rounds):
        part = likely * np.repeat(share, sizes, axis=1)
        part /= np.maximum(part.sum(axis=0), np.float32(1e-30))
        share = (np.add.reduceat(part, first, axis=1) / sizes).astype(np.float32)
    share /= share.sum(axis=0)
    total = np.einsum("lw,lw->w", likely, np.repeat(share, sizes, axis=1))
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), first, dtype=np.float64)


def mixtures(words: list[np.ndarray], penalty: float, rounds: int) -> np.ndarray:
    """Proportions by document and language; ``words`` has their log-likelihoods.

    All languages are tried first.  Sets of the 1, 2, … largest of them
    follow, as long as a larger set is worth its penalty: ``penalty`` times
    half the logarithm of the number of words for each language.
    """
    sizes = np.array([w.shape[1] for w in words])
    every = np.concatenate(words, axis=1)
    every = every - every.max(axis=0)
    likely = np.exp(every)
    n, languages = len(words), len(every)
    start = lambda s: np.concatenate(([0], np.cumsum(s)[:-1]))
    share, _ = _mixture(likely, start(sizes), sizes, np.ones((languages, n)), rounds)
    alone = np.add.reduceat(np.maximum(every, -69), start(sizes), axis=1, dtype=np.float64)
    order = np.argsort(-share, axis=0, kind="stable")
    best_alone = alone.argmax(axis=0)
    best = np.eye(languages)[:, best_alone]
    value = alone[best_alone, np.arange(n)]
    price = penalty * 0.5 * np.log(sizes + 1.0)
    rows, spots = np.arange(n), np.repeat(np.arange(n), sizes)
    for k in range(2, languages + 1):
        chosen = np.zeros((languages, len(rows)))
        np.put_along_axis(chosen, order[:k, rows], 1.0, axis=0)
        of = likely if len(rows) == n else likely[:, np.isin(spots, rows)]
        got, reached = _mixture(of, start(sizes[rows]), sizes[rows], chosen, rounds)
        reached -= price[rows] * (k - 1)
        better = reached > value[rows]
        rows = rows[better]
        if not len(rows):
            break
        best[:, rows], value[rows] = got[:, better], reached[better]
    return best.T


def identify(
    df: DataFrame, model: Model, text: str = "text", penalty: float = 4.0, rounds: int = 8
) -> DataFrame:
    """``row``, ``lang_pred``, ``score`` and ``languages`` of every text.

    ``languages`` lists the selected languages and their proportions, largest
    first; the first is ``lang_pred`` and its proportion the score.  A text
    that is null, empty or has no letter is ``und`` with score 0, and so is
    every text if the model has no languages.  Whole texts count, however
    long; repeated rows are judged alike; ties go to the first language by name.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        languages, table = shared.value.languages, shared.value.log_likelihood
        out = [(UNDETERMINED, 0.0, [])] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and languages and any(map(str.isalpha, t))]
        for part in in_slices(lettered, lambda i: len(texts[i]), SLICE):
            found = [np.concatenate([_word_likelihoods(p, table) for p in _pieces(texts[i])], axis=1) for i in part]
            for i, share in zip(part, mixtures(found, penalty, rounds)):
                order = np.argsort(-share, kind="stable")
                mixed = [{"lang": languages[j], "share": float(share[j])} for j in order if share[j] > 0]
                out[i] = (mixed[0]["lang"], min(1.0, mixed[0]["share"]), mixed)
        return [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

    return computed(df, [text], "lang_pred string, score double, languages array<struct<lang:string,share:double>>", compute)


def known_language(
    df: DataFrame, model: Model, text: str = "text", least: float = 0.3, **options
) -> DataFrame:
    """The rows that have a language, one of them with at least ``least`` of the words."""
    found = identify(df, model, text, **options)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
