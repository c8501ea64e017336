"""Operators over a token annotation table (a parser's output, one token per row).

Columns: ``doc_id, sent_id, tok_id`` (1-based), ``text, lemma, upos``,
``head`` (tok_id of the governor, 0 for the root), ``deprel, ner``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sentiloom import constants as K

SENTENCE = ["doc_id", "sent_id"]


def aspect_candidates(tokens: DataFrame) -> DataFrame:
    """Nouns in a subject, object, attribute or noun-modifier relation."""
    return tokens.where(
        F.col("deprel").isin(*K.ASPECT_RELATIONS) & (F.col("upos") == K.ASPECT_CLASS)
    ).select(*SENTENCE, "tok_id", F.col("text").alias("aspect"))


def _opinions(tokens: DataFrame) -> DataFrame:
    """Adjectives under the token they depend on."""
    return tokens.where(F.col("upos") == K.OPINION_CLASS).select(
        *SENTENCE,
        F.col("head").alias("tok_id"),
        F.col("tok_id").alias("opinion_tok_id"),
        F.col("text").alias("opinion"),
    )


def aspect_opinion_pairs(tokens: DataFrame) -> DataFrame:
    """Subject or object noun with each of its adjectives."""
    nouns = tokens.where(
        F.col("deprel").isin(*K.PAIR_RELATIONS) & (F.col("upos") == K.ASPECT_CLASS)
    ).select(*SENTENCE, "tok_id", F.col("text").alias("aspect"))
    return nouns.join(_opinions(tokens), [*SENTENCE, "tok_id"]).select(
        *SENTENCE, "tok_id", "aspect", "opinion_tok_id", "opinion"
    )


def opinion_of_rows(tokens: DataFrame, rows: DataFrame, aspect: str = "aspect") -> DataFrame:
    """``(doc_id, aspect, opinion)``: first adjective of the first token that equals the row's aspect.

    'False' if there is none.  ``rows`` has one row per (doc_id, aspect).
    """
    wanted = rows.select("doc_id", F.lower(aspect).alias("_name")).distinct()
    nouns = tokens.select(*SENTENCE, "tok_id", F.lower("text").alias("_name")).join(wanted, ["doc_id", "_name"])
    found = (
        nouns.join(_opinions(tokens), [*SENTENCE, "tok_id"])
        .groupBy("doc_id", "_name")
        .agg(F.min(F.struct("sent_id", "tok_id", "opinion_tok_id", "opinion")).alias("_hit"))
    )
    return (
        rows.select("doc_id", aspect, F.lower(aspect).alias("_name"))
        .join(found, ["doc_id", "_name"], "left")
        .select("doc_id", aspect, F.coalesce("_hit.opinion", F.lit(K.NO_OPINION)).alias("opinion"))
    )


def opinion_of(tokens: DataFrame, aspect: str) -> DataFrame:
    """The same for one aspect.

    Only named tokens and adjectives are grouped by sentence; of all others no
    more than the key moves.  A sentence gives the first named token and the
    first adjective under it; the first such sentence of a document counts.
    """
    named = F.lower("text") == aspect.lower()
    is_adjective = F.col("upos") == K.OPINION_CLASS
    adjective = F.when(is_adjective, F.struct("head", F.col("tok_id").alias("tok"), F.col("text").alias("opinion")))
    by_sentence = tokens.where(named | is_adjective).groupBy(*SENTENCE).agg(
        F.array_sort(F.collect_list(F.when(named, F.col("tok_id")))).alias("_named"),
        F.array_sort(F.collect_list(adjective)).alias("_adjectives"),
    )
    under = F.filter("_adjectives", lambda a: F.array_contains("_named", a["head"]))
    first = F.get(under, F.lit(0))
    hits = by_sentence.where(F.size(under) > 0).select(
        "doc_id", F.struct("sent_id", first["head"].alias("tok_id"), first["opinion"].alias("opinion")).alias("_hit")
    )
    every = tokens.select("doc_id").distinct().withColumn("_hit", F.lit(None).cast(hits.schema["_hit"].dataType))
    return (
        hits.unionByName(every)
        .groupBy("doc_id")
        .agg(F.min("_hit").alias("_hit"))
        .select("doc_id", F.coalesce("_hit.opinion", F.lit(K.NO_OPINION)).alias("opinion"))
    )


LISTS = ("text", "lemma", "upos", "head", "deprel", "ner")
# Bytes of unpacked tokens that a task turns into lists at a time.
UNPACKED = 16 << 20


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    one, other = column.slice(0, max(len(column) - 1, 0)), column.slice(1)
    differs = pc.coalesce(pc.not_equal(one, other), pc.xor(one.is_valid(), other.is_valid()))
    return np.append(np.ones(min(len(column), 1), bool), differs.to_numpy(zero_copy_only=False).astype(bool))


def _cutter(column: pa.Array, starts: np.ndarray) -> Callable:
    """The bytes of rows ``low`` to ``high``, where ``low`` is one of ``starts``: what compresses well.

    Numbers are steps from row to row and texts have lengths, not ends; of
    either the first bytes come first, then the second ones and so on.
    """
    planes = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    ends, data = np.zeros(len(column) + 1, np.int64), pa.py_buffer(b"")
    if pa.types.is_integer(column.type):
        x = column.fill_null(0).to_numpy(zero_copy_only=False)
        steps = np.diff(x, prepend=x[:1] * 0)
        steps[starts] = x[starts]
        numbers = planes(steps)
    elif pa.types.is_string(column.type):
        x = column.fill_null("")
        ends = np.frombuffer(x.buffers()[1], "<i4")[x.offset : x.offset + len(x) + 1]
        numbers, data = planes(np.diff(ends)), x.buffers()[2] or data
    else:
        return lambda low, high: [pa.RecordBatch.from_arrays([column.slice(low, high - low)], ["x"]).serialize().to_pybytes()]
    valid = column.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    return lambda low, high: [
        valid[low:high].tobytes(), numbers[:, low:high].tobytes(), data[int(ends[low]) : int(ends[high])].to_pybytes()
    ]


def _column(kind: pa.DataType, n: int, parts: list[bytes]) -> pa.Array:
    """What :func:`_cutter` took apart."""
    if len(parts) == 1:
        return pa.ipc.read_record_batch(pa.py_buffer(parts[0]), pa.schema([("x", kind)])).column(0)
    valid, numbers = (np.frombuffer(p, np.uint8) for p in parts[:2])
    numbers = np.ascontiguousarray(numbers.reshape(-1, n).T)
    if pa.types.is_integer(kind):
        steps = numbers.view(kind.to_pandas_dtype()).ravel()
        return pa.array(np.cumsum(steps, dtype=steps.dtype), kind, mask=valid == 0)
    ends = np.append(0, np.cumsum(numbers.view("<i4"))).astype("<i4")
    known = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(parts[2]), known)


def _packer(schema: pa.Schema) -> Callable:
    """Rows of one comment that follow each other, as one compressed row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            starts = np.flatnonzero(_changes(keys)).tolist()
            cutters = [_cutter(c.cast(k), starts) for c, k in zip(batch.columns[1:], schema.types)]
            runs = zip(starts, [*starts[1:], len(keys)])
            data = [pickle.dumps((high - low, [cut(low, high) for cut in cutters]), 5) for low, high in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(starts, pa.int64())),
                    pa.array([len(d) for d in data], pa.int64()),
                    pa.array([pa.compress(d, "zstd", asbytes=True) for d in data], pa.binary()),
                ],
                ["doc_id", "size", "data"],
            )

    return packed


def _unpacker(schema: pa.Schema, out: list[str], per_sentence: bool) -> Callable:
    """Lists of the comments, or sentences, that come in order of their comment."""

    def lists(docs: list, parts: list[pa.RecordBatch], kind: pa.DataType) -> pa.RecordBatch:
        turns = [0, *(i for i in range(1, len(docs)) if docs[i] != docs[i - 1])]
        which = np.repeat(np.searchsorted(turns, range(len(docs)), side="right") - 1, [len(p) for p in parts])
        rows = pa.Table.from_batches(parts, schema).append_column("_which", pa.array(which))
        places = [(n, "ascending") for n in ("_which", "sent_id", "tok_id", *LISTS)]
        rows = rows.take(pc.sort_indices(rows, sort_keys=places, null_placement="at_start")).combine_chunks()
        at = rows["_which"].to_numpy()
        new = np.diff(at, prepend=-1) != 0
        if per_sentence:
            new |= _changes(rows["sent_id"].combine_chunks())
        starts = np.flatnonzero(new)
        ends = pa.array(np.append(starts, len(at)), pa.int32())
        keys = [pa.array([docs[t] for t in turns], kind).take(pa.array(at[starts]))]
        if per_sentence:
            keys.append(rows["sent_id"].take(pa.array(starts)).combine_chunks())
        columns = [pa.ListArray.from_arrays(ends, c) for c in (rows[n].combine_chunks() for n in LISTS)]
        return pa.RecordBatch.from_arrays([*keys, *columns], out)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held > UNPACKED and doc != docs[-1]:
                    yield lists(docs, parts, kind)
                    docs, parts, held = [], [], 0
                docs.append(doc)
                n, columns = pickle.loads(pa.decompress(data, size, "zstd", asbytes=True))
                parts.append(pa.RecordBatch.from_arrays([_column(k, n, c) for k, c in zip(schema.types, columns)], schema=schema))
                held += size
        if docs:
            yield lists(docs, parts, kind)

    return unpacked


def annotation_lists(tokens: DataFrame, per_sentence: bool = False) -> DataFrame:
    """Six parallel lists per comment, or per sentence of a comment.

    A comment is one text cell, so its list is no longer than that cell.
    Tokens of a comment that stand together move as one compressed row;
    they may come in any order and any number of such rows.
    """
    keys = SENTENCE if per_sentence else ["doc_id"]
    rows = tokens.select(*SENTENCE, "tok_id", *LISTS)
    inner = to_arrow_schema(rows.drop("doc_id").schema)
    out = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys])
    for c in LISTS:
        out = out.add(f"{c}_list", T.ArrayType(rows.schema[c].dataType))
    row = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("size", "long").add("data", "binary")
    placed = rows.mapInArrow(_packer(inner), row).repartition("doc_id").sortWithinPartitions("doc_id")
    return placed.mapInArrow(_unpacker(inner, out.names, per_sentence), out)
