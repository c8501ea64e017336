"""Token id arrays as Column expressions: masks and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentiloom.functions.text import col, let


def aspect_mask(ids: Column | str, aspect: Column | str) -> Column:
    """1 on every token that an occurrence of ``aspect`` covers, else 0.

    Occurrences may overlap.  An empty aspect covers nothing.
    """

    def with_ids(tokens: Column) -> Column:
        def with_aspect(term: Column) -> Column:
            m = F.array_size(term)
            begins = F.transform(
                tokens,
                lambda t, i: (t == F.get(term, F.lit(0)))
                & (F.slice(tokens, i + 1, m) == term),
            )

            def spread(hit: Column) -> Column:
                first = lambda j: F.greatest(j - m + 2, F.lit(1))
                return F.transform(
                    hit,
                    lambda _, j: F.array_contains(
                        F.slice(hit, first(j), j + 2 - first(j)), True
                    ).cast("int"),
                )

            return F.when(
                (m > 0) & F.arrays_overlap(tokens, term), let(begins, spread)
            ).otherwise(F.array_repeat(F.lit(0), F.array_size(tokens)))

        return let(col(aspect), with_aspect)

    return F.when(col(ids).isNotNull() & col(aspect).isNotNull(), let(col(ids), with_ids))


def pad(ids: Column | str, length: Column, value: int = 0) -> Column:
    ids = col(ids)
    return F.concat(ids, F.array_repeat(F.lit(value), (length - F.array_size(ids)).cast("int")))


def attention(ids: Column | str, length: Column) -> Column:
    """1 for a real token, 0 for padding."""
    n = F.array_size(col(ids))
    return F.concat(
        F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), (length - n).cast("int"))
    )
