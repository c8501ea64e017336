"""Text as Column expressions: tokens, sentences, counts, marks.

All of these stay inside one row, so none of them moves data between tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentiloom import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain reference inside a lambda is evaluated again for every element;
    a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column | str, lower: bool = True) -> Column:
    """Runs of letters, lower-cased unless ``lower`` is off."""
    text = F.lower(col(text)) if lower else col(text)
    return F.regexp_extract_all(text, F.lit(K.WORD), F.lit(1))


def hashes(tokens: Column, seed: int) -> Column:
    """A long for each token; which seed tells all of a vocabulary apart is to be checked."""
    return F.transform(tokens, lambda w: F.xxhash64(w, F.lit(seed)))


def alphanumerics(text: Column | str) -> Column:
    """Runs of letters and runs of digits, lower-cased."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(K.WORD_OR_NUMBER), F.lit(1))


def surface_tokens(text: Column | str) -> Column:
    """Words with inner apostrophes, numbers and single punctuation marks."""
    return F.regexp_extract_all(col(text), F.lit(K.SURFACE_TOKEN), F.lit(1))


def sentences(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(K.SENTENCE), F.lit(1))


def strip(text: Column | str) -> Column:
    """Drop blanks of any kind at both ends."""
    return F.regexp_replace(col(text), f"^{K.BLANK}++|(?<!{K.BLANK}){K.BLANK}++$", "")


def one_line(text: Column | str) -> Column:
    """Line feeds become blanks, ends are stripped."""
    return strip(F.replace(col(text), F.lit("\n"), F.lit(" ")))


def blank_words(text: Column | str, limit: int = -1) -> Column:
    """Pieces between blanks; a positive limit leaves the rest in the last piece."""
    return F.filter(F.split(col(text), f"{K.BLANK}++", limit), lambda w: w != "")


def truncate_words(
    text: Column | str, n: int = K.MAX_LENGTH - K.RESERVED_WORDS
) -> Column:
    """The first ``n`` blank-separated words, single blanks between them."""
    return F.array_join(F.slice(blank_words(text, n + 2), 1, n), " ")


def word_counts(tokens: Column) -> Column:
    """``array<struct<word, k>>`` of an array of words: sort it, cut it into runs."""

    def runs(s: Column) -> Column:
        starts = F.array_compact(
            F.transform(s, lambda w, i: F.when(~w.eqNullSafe(F.get(s, i - 1)), i))
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda b, j: F.struct(
                    F.get(s, b).alias("word"),
                    (F.coalesce(F.get(at, j + 1), F.array_size(s)) - b).alias("k"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


def entropy(tokens: Column) -> Column:
    """Shannon entropy in bits of the word distribution; NULL without words."""

    def bits(ws: Column) -> Column:
        inner = F.aggregate(
            word_counts(ws),
            F.lit(0.0),
            lambda a, c: a + c["k"] * F.log2(c["k"].cast("double")),
        )
        n = F.array_size(ws).cast("double")
        return F.when(n > 0, F.log2(n) - inner / n)

    return let(tokens, bits)


def adjacent_pairs(tokens: Column | str) -> Column:
    """``array<struct<v, w>>`` of neighbours, in order."""
    ws = col(tokens)
    n = F.greatest(F.array_size(ws) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ws, 1, n).alias("v"), F.slice(ws, 2, n).alias("w"))


def mark_modifiers(text: Column | str) -> Column:
    """Put ``NOT_`` / ``INTENSIFIED_`` on the token that follows modifiers.

    Only plain tokens look back, and only over the modifiers right before
    them, so the work is linear in the text however long a run gets.
    """

    def kinds(tokens: Column) -> Column:
        return F.transform(
            F.transform(tokens, F.lower),
            lambda w: F.when(w.isin(*K.NEGATIONS), 1)
            .when(w.isin(*K.INTENSIFIERS), 2)
            .otherwise(0),
        )

    def marked(tokens: Column, kind: Column, plain: Column) -> Column:
        def piece(p: Column, j: Column) -> Column:
            before = F.coalesce(F.get(plain, j - 1), F.lit(-1))
            run = p - before - 1
            mods = F.slice(kind, before + 2, run)
            return F.when(run == 0, F.get(tokens, p)).otherwise(
                F.concat(
                    F.array_join(F.slice(tokens, before + 2, run), " "),
                    F.lit(" "),
                    F.when(F.array_contains(mods, 2), K.INTENSIFIER_MARK).otherwise(""),
                    F.when(F.array_contains(mods, 1), K.NEGATION_MARK).otherwise(""),
                    F.get(tokens, p),
                )
            )

        last = F.coalesce(F.get(plain, F.array_size(plain) - 1), F.lit(-1))
        tail = F.slice(tokens, last + 2, F.array_size(tokens) - last - 1)
        return F.array_join(F.concat(F.transform(plain, piece), tail), " ")

    def body(tokens: Column) -> Column:
        def with_kinds(kind: Column) -> Column:
            plain = F.array_compact(F.transform(kind, lambda k, i: F.when(k == 0, i)))
            return F.when(
                F.exists(kind, lambda k: k > 0),
                let(plain, lambda p: marked(tokens, kind, p)),
            ).otherwise(F.array_join(tokens, " "))

        return let(kinds(tokens), with_kinds)

    return let(surface_tokens(text), body)


def first_sentence_with(text: Column | str, aspect: Column) -> Column:
    """First sentence that holds ``aspect``; NULL if none does."""
    return F.get(
        F.filter(sentences(text), lambda s: F.contains(s, aspect)), F.lit(0)
    )


def context_window(
    text: Column | str, aspect: Column, size: int = K.CONTEXT_WINDOW
) -> Column:
    """Tokens around the first occurrence of ``aspect``, joined by blanks."""

    def cut(tokens: Column) -> Column:
        def around(at: Column) -> Column:  # 1-based, 0 when absent
            start = F.greatest(at - size, F.lit(1)).cast("int")
            stop = F.least(at + size, F.array_size(tokens)).cast("int")
            return F.when(
                at > 0, F.array_join(F.slice(tokens, start, stop - start + 1), " ")
            )

        return let(F.array_position(tokens, aspect), around)

    return let(surface_tokens(text), cut)


def contained(text: Column | str, terms: Iterable[str]) -> Column:
    """Those of ``terms`` that occur in the text, case-sensitive."""
    held = F.array(*[F.when(F.contains(col(text), F.lit(t)), F.lit(t)) for t in terms])
    return F.array_compact(held)


def compound(total: Column) -> Column:
    """Squash a sum of valences into (-1, 1)."""
    return total / F.sqrt(total * total + K.COMPOUND_ALPHA)
