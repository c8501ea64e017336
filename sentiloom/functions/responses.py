"""Model answers as Column expressions: JSON arrays, booleans, label words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom import constants as K
from sentiloom.functions.text import blank_words, col, let, strip


def json_array(response: Column | str) -> Column:
    """From the first ``[`` to a ``]`` that ends the answer; NULL otherwise."""
    return let(
        strip(response),
        lambda s: F.when(
            (F.instr(s, "[") > 0) & F.endswith(s, F.lit("]")),
            F.substr(s, F.instr(s, "[")),
        ),
    )


def items(response: Column | str) -> Column:
    """Entries of the JSON array as JSON texts, at their own positions.

    Single quotes are read as they stand, so an apostrophe inside a double
    quoted value survives.
    """
    return F.from_json(json_array(response), T.ArrayType(T.StringType()))


def reject_reason(response: Column | str) -> Column:
    """Why an answer cannot be used; NULL when every entry is an object."""

    def why(parsed: Column) -> Column:
        return (
            F.when(json_array(response).isNull(), "no array")
            .when(parsed.isNull(), "not json")
            .when(F.array_size(parsed) == 0, "empty array")
            .when(
                F.exists(parsed, lambda e: ~F.coalesce(F.startswith(e, F.lit("{")), F.lit(False))),
                "entry is not an object",
            )
        )

    return let(items(response), why)


def parse(response: Column | str, entry: str) -> Column:
    """Array of structs; an entry that is not an object becomes NULL in place."""
    return F.transform(
        items(response),
        lambda e: F.when(F.startswith(e, F.lit("{")), F.from_json(e, entry)),
    )


ASPECT_ENTRY = "aspectTerm string"
LABEL_ENTRY = "polarity int, implicitness string"


def as_list(value: Column | str) -> Column:
    """A single term or a JSON list of terms, always as an array."""
    value = col(value)
    listed = F.when(
        F.startswith(value, F.lit("[")),
        F.from_json(value, T.ArrayType(T.StringType())),
    )
    return F.when(value.isNotNull(), F.coalesce(listed, F.array(value)))


def parse_bool(value: Column | str) -> Column:
    """Usual spellings of a boolean; anything else is NULL."""
    text = F.lower(col(value).cast("string"))
    return F.when(text.isin(*K.TRUE_WORDS), F.lit(True)).when(
        text.isin(*K.FALSE_WORDS), F.lit(False)
    )


def bool_reject(value: Column | str) -> Column:
    """Why a boolean text is refused; NULL when it was read."""
    return F.when(
        parse_bool(value).isNull(),
        F.concat(F.lit("not a boolean: "), F.coalesce(col(value).cast("string"), F.lit("NULL"))),
    )


def strip_specials(text: Column | str) -> Column:
    out = col(text)
    for marker in K.SPECIAL_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    return strip(out)


def label_name(code: Column | str) -> Column:
    """0, 1, 2 to words; other codes are NULL."""
    return F.get(F.array(*map(F.lit, K.LABELS)), col(code).cast("int"))


def label_code(name: Column | str) -> Column:
    """Words to 0, 1, 2; other words are NULL."""
    out = F.when(col(name) == K.LABELS[0], 0)
    for code, word in enumerate(K.LABELS[1:], 1):
        out = out.when(col(name) == word, code)
    return out


def decode_exact(answer: Column | str) -> Column:
    """Label code of an answer that is exactly a label; anything else is 0."""
    return F.coalesce(label_code(strip_specials(answer)), F.lit(0))


def decode_contains(answer: Column | str) -> Column:
    """Code of the first label, in code order, found in the answer; else 2."""
    text = F.lower(col(answer))
    out = F.when(F.contains(text, F.lit(K.LABELS[0])), 0)
    for code, word in enumerate(K.LABELS[1:], 1):
        out = out.when(F.contains(text, F.lit(word)), code)
    return out.otherwise(2)


def split_terms(answer: Column | str) -> Column:
    return F.split(col(answer), ", ")


def is_none_aspect(aspect: Column | str) -> Column:
    return col(aspect) == K.NONE_ASPECT


def trace_record(
    sentence, target, gold, implicit, steps: list[Column], predicted
) -> Column:
    """Ten lines of one reasoning record; every field is put on one line.

    A step without text becomes a blank: line feeds in a row end a record.
    """

    def line(c: Column | str) -> Column:
        return strip(F.regexp_replace(col(c), r"[\t\n\r]", " "))

    def step(c: Column) -> Column:
        return F.coalesce(F.nullif(line(c), F.lit("")), F.lit(" "))

    head = F.concat_ws(
        "\t", step(sentence), step(target), col(gold), col(implicit).cast("string")
    )
    tail = F.concat(F.lit("gold: "), col(gold), F.lit("\tpredicted: "), F.coalesce(col(predicted), F.lit(K.NO_LABEL)))
    return F.concat_ws("\n", head, *[step(s) for s in steps], tail)


def _fields(lines: Column) -> Column:
    head = F.split(F.get(lines, F.lit(0)), "\t")
    result = F.split(F.get(lines, F.lit(9)), "\t")
    word = lambda c: F.get(blank_words(c), F.lit(1))
    return F.struct(
        F.get(head, F.lit(0)).alias("sentence"),
        F.get(head, F.lit(1)).alias("target"),
        word(F.get(result, F.lit(0))).alias("gold"),
        F.get(head, F.lit(3)).try_cast("int").alias("implicit"),
        word(F.get(result, F.lit(1))).alias("predicted"),
    )


def trace_fields(record: Column | str) -> Column:
    """Struct of the fields that lines 0 and 9 of a record carry."""
    return let(F.split(col(record), "\n"), _fields)


def trace_reject(record: Column | str) -> Column:
    """Why a record is unreadable; NULL when it has its ten lines and labels."""

    def unknown(fields: Column) -> Column:
        return F.when(label_code(fields["gold"]).isNull() | label_code(fields["predicted"]).isNull(), "unknown label")

    def why(lines: Column) -> Column:
        shape = F.when(F.array_size(lines) != 10, "not ten lines").when(
            F.array_size(F.split(F.get(lines, F.lit(0)), "\t")) != 4, "not four fields"
        )
        return F.coalesce(shape, let(_fields(lines), unknown))

    return let(F.split(col(record), "\n"), why)
