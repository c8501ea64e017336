"""Topics of any vocabulary: expectation-maximisation over blocks of documents.

Every table here is keyed by word, by document or by block of documents.  What
reaches the driver are ``k`` sums a round, some counts and one label a block,
however many words there are.

A document mixes topics, a topic is a distribution over words.  In each round a
word's weights travel to the blocks that hold it; a task finds the mixtures of
its documents by ``passes`` fixed-point steps and gives back, for each word, what
every topic takes of it.  The sums by word are stored and are the next weights.
``alpha`` and ``eta`` are added to the counts of topics in a document and of words
in a topic.

Documents move once: they are stored in as many buckets as there are blocks, and a
round meets them where they lie.  So a round moves words only, and the larger a
block is, the fewer blocks a word is sent to.  A task holds one block: the weights
of its words and at most about ``ENTRIES`` (document, word) entries of 8 bytes; a
document is never split, so one with more different words than that is a block's
content for itself.

Each row is a document, also where keys or texts repeat.  A row without a content
word (a NULL or empty text, stop words only) has no mixture: its ``topics`` are
NULL.  Without any word there is no topic row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom import constants as K
from sentiloom.functions import text as X
from sentiloom.operators.scale import bucket_labels as _labels
from sentiloom.operators.scale import lookup_join, stored
from sentiloom.session import ensure_checkpoint_dir

# (document, word) entries of a block, of one block in a small corpus, of one step in numpy.
ENTRIES, PIECE, STEP = 1 << 23, 1 << 15, 1 << 15


class Topics(NamedTuple):
    """``words (word, id, weights)``, counts by topic; ``documents (key, topics)``, shares."""

    words: DataFrame
    documents: DataFrame


def _content(docs: DataFrame, key: str, text: str, stop: Sequence[str]) -> DataFrame:
    """``(key, at, counts)``, stored: the number of a row and what words it holds."""
    words = F.filter(X.alphanumerics(text), lambda w: ~w.isin(*stop))
    rows = docs.select(F.col(key).alias("key"), X.word_counts(words).alias("counts"))
    return stored(rows.withColumn("at", F.monotonically_increasing_id()), "topic-content")


def _lexicon(content: DataFrame, min_df: int, seed: int) -> tuple[DataFrame, int]:
    """``(word, id, n)``, stored, with a seed under which no two words share an id."""
    rows = content.select(F.inline("counts"))
    words = stored(
        rows.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("df")).where(F.col("df") >= min_df).drop("df"),
        "topic-words",
    )
    while True:
        named = words.select("word", F.xxhash64("word", F.lit(seed)).alias("id"), "n")
        if named.groupBy("id").count().where("count > 1").isEmpty():
            return named, seed
        seed += 1


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's words by their place among its ids, and, in a row without a document, these ids."""

    def rows(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [b.column(2) for b in held]
        ids, words = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)
        words, first = words.astype(np.int32), 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int32())),
             pa.array([None], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))],
            names,
        )
        for b, x in zip(held, lists):
            ends = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]).astype(np.int32)
            w = pa.ListArray.from_arrays(pa.array(ends), pa.array(words[first : first + ends[-1]]))
            first += int(ends[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), w, b.column(3), pa.nulls(len(b), pa.list_(pa.int64()))], names)

    names, at, held = ["block", "at", "w", "n", "ids"], None, []
    for batch in batches:
        where = batch.column(0).to_numpy()
        turns = (np.flatnonzero(np.diff(where)) + 1).tolist()
        for low, high in zip([0, *turns], [*turns, len(where)]):
            if low == high:
                continue
            if held and where[low] != at:
                yield from rows(int(at), held)
                held = []
            at = where[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield from rows(int(at), held)


def _pieces(content: DataFrame, words: DataFrame, blocks: int, seed: int, min_df: int) -> DataFrame:
    """``(block, at, w, n, ids)``: documents in the bucket of their block."""
    spark = content.sparkSession
    labels = F.array(*[F.lit(i) for i in _labels(spark, blocks)])
    block = F.element_at(labels, F.pmod(F.hash("at"), F.lit(blocks)) + 1)
    if min_df > 1:  # what too few rows hold has no weights
        rows = content.select("at", F.inline("counts"))
        kept = lookup_join(rows, words.select("word"), ["word"], "left_semi")
        counts = F.array_sort(F.collect_list(F.struct("word", "k"))).alias("counts")
        content = kept.groupBy("at").agg(counts)
    rows = content.where(F.size("counts") > 0).select(
        block.alias("block"),
        "at",
        F.transform("counts", lambda c: F.xxhash64(c["word"], F.lit(seed))).alias("ids"),
        F.transform("counts", lambda c: c["k"].cast("int")).alias("n"),
    )
    placed = rows.repartition(blocks, "block").sortWithinPartitions("block", "at")
    numbered = placed.mapInArrow(_numbered, "block int, at bigint, w array<int>, n array<int>, ids array<bigint>")
    ensure_checkpoint_dir(spark)
    name = f"topic_entries_{uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    numbered.write.bucketBy(blocks, "block").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def mixtures(p: np.ndarray, n: np.ndarray, starts: np.ndarray, alpha: float, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document, and what each topic takes of each entry; a row is a topic.

    ``p`` are the entries' word probabilities, documents begin at ``starts``.
    """
    lengths = np.diff(np.append(starts, len(n)))
    shares = np.full((len(p), len(starts)), 1.0 / len(p))
    for _ in range(passes):
        taken = p * np.repeat(shares, lengths, axis=1)
        taken *= n / taken.sum(axis=0)
        shares = np.add.reduceat(taken, starts, axis=1) + alpha
        shares /= shares.sum(axis=0)
    return shares, taken


def _block_rows(ids, weights, pieces, k: int, alpha: float, passes: int, documents: bool) -> list[np.ndarray]:
    """One block: sums by word, or shares by document; the first column is their id."""
    order = np.argsort(ids)
    ids, weights = ids[order], np.ascontiguousarray(weights[:, order])
    sums, keys, found = np.zeros_like(weights), [], []
    for at, words, counts, ends in pieces:
        first = 0
        while first < len(at):  # whole documents, STEP entries or a little more at a time
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP)))
            last = min(last, len(at))
            low, high = ends[first], ends[last]
            w, n = words[low:high], counts[low:high].astype(float)
            shares, taken = mixtures(weights[:, w], n, ends[first:last] - low, alpha, passes)
            if documents:
                keys.append(at[first:last])
                found.append(shares)
            else:
                by_word = np.argsort(w, kind="stable")
                heads = np.flatnonzero(np.diff(w[by_word], prepend=-1))
                sums[:, w[by_word][heads]] += np.add.reduceat(taken[:, by_word], heads, axis=1)
            first = last
    if documents:
        ids, sums = np.concatenate(keys), np.concatenate(found, axis=1)
    return [ids, *sums]


def _names(first: str, k: int) -> list[str]:
    return [first, *(f"s{i}" for i in range(k))]


def _pass(pieces: DataFrame, chances: DataFrame, k: int, alpha: float, passes: int, documents: bool) -> DataFrame:
    """Meet each block with the chances ``(block, id, p0, …)`` of its words."""
    kinds = pa.schema([("id", pa.int64()), *((n, pa.float64()) for n in _names("id", k)[1:])])

    def solved(held: pa.Table, words: pa.Table) -> pa.Table:
        if not held.num_rows or not words.num_rows:
            return kinds.empty_table()
        lists = []
        for batch in held.to_batches():
            if batch.num_rows:
                n = batch["n"]
                ends = np.concatenate([[0], np.cumsum(n.value_lengths().to_numpy())])
                lists.append((batch["at"].to_numpy(), batch["w"].flatten().to_numpy(), n.flatten().to_numpy(), ends))
        weights = np.stack([words[f"p{i}"].to_numpy() for i in range(k)])
        rows = _block_rows(words["id"].to_numpy(), weights, lists, k, alpha, passes, documents)
        return pa.Table.from_arrays([pa.array(r) for r in rows], schema=kinds)

    entries = pieces.where(F.col("at").isNotNull()).select("block", "at", "w", "n")
    kind = ", ".join(["id bigint", *(f"s{i} double" for i in range(k))])
    return entries.groupBy("block").cogroup(chances.groupBy("block")).applyInArrow(solved, kind)


def start_weights(words: DataFrame, k: int, seed: int) -> DataFrame:
    """A word's count dealt to the topics at random, by its hash."""
    chance = lambda i: (F.shiftrightunsigned(F.xxhash64("id", F.lit(i), F.lit(seed)), 11) + 0.5) * 2.0**-53
    draws = [-F.log(chance(i)) for i in range(k)]
    total = sum(draws[1:], draws[0])
    return words.select("id", *[(F.col("n") * d / total).alias(f"s{i}") for i, d in enumerate(draws)])


def _chances(places: DataFrame, weights: DataFrame, k: int, eta: float) -> DataFrame:
    """``(block, id, p0, …)``: the chance of a word in each topic, for each block that holds it."""
    row = weights.agg(F.count("*").alias("v"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(k)]).first()
    smooth = lambda i: (F.col(f"s{i}") + eta) / ((row[f"t{i}"] or 0.0) + eta * max(row["v"], 1))
    rows = places.join(weights.select("id", *[smooth(i).alias(f"p{i}") for i in range(k)]), "id")
    return rows.select(F.explode("blocks").alias("block"), "id", *[f"p{i}" for i in range(k)])


def corpus_topics(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    rounds: int = 10,
    passes: int = 5,
    alpha: float = 0.1,
    eta: float = 0.01,
    stop: Sequence[str] = K.STOP_WORDS,
    min_df: int = 1,
    seed: int = 42,
    block: int = ENTRIES,
) -> Topics:
    """Topics over the content words that ``min_df`` rows hold at least."""
    content = _content(docs, key, text, stop)
    entries = content.agg(F.sum(F.array_size("counts"))).first()[0] or 0
    slots = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(slots, -(-entries // PIECE)))  # whole waves of tasks beyond that
    if entries > block * blocks:
        blocks = -(-entries // (block * slots)) * slots
    words, seed = _lexicon(content, min_df, seed)
    pieces = _pieces(content, words, blocks, seed, min_df)
    held = pieces.where(F.col("at").isNull()).select("block", F.explode("ids").alias("id"))
    places = stored(held.groupBy("id").agg(F.collect_list("block").alias("blocks")), "topic-places")
    weights = stored(start_weights(words, k, seed), "topic-weights")
    for _ in range(rounds):
        parts = _pass(pieces, _chances(places, weights, k, eta), k, alpha, passes, documents=False)
        summed = parts.groupBy("id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
        weights = stored(summed, "topic-weights")
    found = _pass(pieces, _chances(places, weights, k, eta), k, alpha, passes, documents=True)
    listed = F.array(*[f"s{i}" for i in range(k)])
    shares = found.select(F.col("id").alias("at"), listed.alias("topics"))
    return Topics(
        words.select("word", "id").join(weights.select("id", listed.alias("weights")), "id").select("word", "id", "weights"),
        content.select("at", F.col("key").alias(key)).join(shares, "at", "left").select(key, "topics"),
    )


def _ranked(by: Column) -> Column:
    return (F.row_number().over(Window.partitionBy("topic").orderBy(by.desc(), "word")) - 1).cast("int")


def top_words(words: DataFrame, n: int = 5) -> DataFrame:
    """``(topic, rank, word, weight)``: the ``n`` most probable words of each topic, ties by word.

    Each task keeps ``n`` rows a topic before any of them moves.
    """
    rows = words.select("word", F.posexplode("weights").alias("topic", "weight"))
    totals = rows.groupBy("topic").agg(F.sum("weight").alias("_total"))
    best = rows.withColumn("rank", _ranked(F.col("weight"))).where(F.col("rank") < n)
    share = (F.col("weight") / F.col("_total")).alias("weight")
    return best.join(F.broadcast(totals), "topic").select("topic", "rank", "word", share)
