"""Word vectors of any vocabulary: pair counts, shifted PMI, a truncated SVD.

Every table here is keyed by word or by block of words.  What reaches the
driver are matrices of ``(size + EXTRA)²`` numbers, however many words there are.

Words that stand near each other are counted once (:func:`near_counts`); what
their PMI exceeds a shift by is a sparse symmetric matrix
(:func:`pmi_entries`).  Its largest eigenvectors are found by multiplying a
block of random columns with the matrix, over and over (:func:`pmi_vectors`).
Neighbours come from random hyperplanes and are ranked by exact cosines
(:func:`nearest_words`).

The matrix is cut into groups of rows, of at most ``GROUP`` blocks, and blocks of
columns.  A task holds the sums of a group of rows, however many words there
are, and the vectors of one block of columns; entries stream past in pieces of
bounded size.  A group is sent the vectors of its own columns only, so a word
travels no more often than it has neighbours, and sums do not travel.

Most neighbours of any word are among the frequent ones.  Where a vocabulary is
large these come first, as the head, and the head's rows are cut by columns
instead: a slice holds sums for the whole head over its own columns, and these
parts are added.  So a rare word is sent to one slice and to the few groups of
other rare words near it, however many groups there are.

A NULL text has no words.  No text, or texts of one word each, give no
vectors.  Rows that repeat count as often as they stand there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.functions import text as X
from sentiloom.operators.scale import bucket_labels, dense_index, fits_broadcast, head_cut, lookup_join, stored

# Columns of the random block beyond the wanted ones.
EXTRA = 10
# Part of the largest eigenvalue of a Gram matrix below which a direction is rounding error.
NOISE = 1e-10
# Words in a block of columns, such blocks in a group of rows.  Parquet looks at the size of a
# page after 100 rows and each codec holds a page beside the heap, so a stored block is small.
BLOCK, GROUP = 512, 256
# Pairs that a task counts at a time; ranges of ids, at least; pairs of a range that are added at
# a time, and that are given back at a time.
PAIRED, CELLS, MERGED, SENT = 5 << 20, 256, 1 << 21, 1 << 16
# Words of the head at most; a vocabulary of that size has none.
HEAD = BLOCK * GROUP
# Pairs of a target and a candidate that are few enough to go to all tasks.
PAIRS = 1_000_000
# Words whose random signs are drawn together.
DRAWN = 4096


def _ids(words: Column, seed: int) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w, F.lit(seed)))


def word_ids(docs: DataFrame, text: str = "text", seed: int = 42) -> tuple[DataFrame, int]:
    """``(word, id, n)`` for every word, stored, and the seed of the ids.

    Ids are hashes, made where the word stands.  Should two words share one,
    all get others from the next seed.
    """
    words = stored(
        docs.select(F.explode(X.words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
        "words",
    )
    while True:
        named = words.select("word", F.xxhash64("word", F.lit(seed)).alias("id"), "n")
        if named.groupBy("id").count().where("count > 1").isEmpty():
            return named, seed
        seed += 1


def _line_counts(window: int, cells: int) -> Callable:
    """Counts of the pairs of some words: a compressed row ``(cell, size, data)`` for each range of first ids."""
    most = max(1, PAIRED // window)

    def rows(ids: np.ndarray, line: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, at = np.unique(ids, return_inverse=True)
        pairs = []
        for d in range(1, min(window, len(at) - 1) + 1):
            same = line[d:][:most] == line[:-d][:most]
            one, other = at[d:][:most][same], at[:-d][:most][same]
            pairs.append(np.minimum(one, other) * len(known) + np.maximum(one, other))
        pairs, n = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]), return_counts=True)
        one, other = np.divmod(pairs, len(known))
        cell = (((known >> 40) + (1 << 23)) * cells >> 24)[one]
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            first, k = np.unique(one[low:high], return_counts=True)
            second, where = np.unique(other[low:high], return_inverse=True)
            small = [x.astype(np.min_scalar_type(x.max())) for x in (k, where, n[low:high])]
            data = pickle.dumps([known[first], known[second], *small], 5)
            kinds = (pa.int32(), pa.int64(), pa.binary())
            row = (int(cell[low]), len(data), pa.compress(data, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["cell", "size", "data"])

    def parts(ids: list, lengths: list) -> Iterator[pa.RecordBatch]:
        words, lengths = np.concatenate(ids), np.concatenate(lengths)
        line = np.repeat(np.arange(len(lengths)), lengths)
        for low in range(0, len(words), most):  # a pair belongs to the part of its first word
            yield from rows(words[low : low + most + window], line[low : low + most + window])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = [], []
        for batch in batches:
            lines = batch.column(0)
            ids.append(lines.flatten().to_numpy())
            lengths.append(lines.value_lengths().to_numpy())
            if sum(map(len, ids)) >= most:
                yield from parts(ids, lengths)
                ids, lengths = [], []
        if ids:
            yield from parts(ids, lengths)

    return counted


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, n)`` of the rows of a cell, which follow each other."""

    def added(held: list) -> tuple:
        firsts, seconds, k, where, n = zip(*held)
        a, at = np.unique(np.concatenate(firsts), return_inverse=True)
        b, to = np.unique(np.concatenate(seconds), return_inverse=True)
        starts = np.cumsum([0, *map(len, seconds)])
        key = np.repeat(at, np.concatenate(k)) * len(b) + to[np.concatenate([w + s for w, s in zip(where, starts)])]
        order = np.argsort(key)
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        one, other = np.divmod(key[order[new]], len(b))
        return a, b, one, other, np.add.reduceat(np.concatenate(n).astype(np.int64)[order], new)

    def rows(held: list) -> Iterator[pa.RecordBatch]:
        a, b, one, other, n = added(held)
        for low in range(0, len(n), SENT):
            part = slice(low, low + SENT)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[one[part]], b[other[part]], n[part])], ["a", "b", "n"])

    cell, held, many = None, [], 0
    for batch in batches:
        for here, size, data in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
            if here != cell and held:
                yield from rows(held)
                held, many = [], 0
            cell = here
            held.append(pickle.loads(pa.decompress(data.as_buffer(), size, "zstd", asbytes=True)))
            many += len(held[-1][3])
            if many > MERGED:  # what repeats is added before more is read
                a, b, one, other, n = added(held)
                first, k = np.unique(one, return_counts=True)
                held, many = [[a[first], b, k, other, n]], 0
    if held:
        yield from rows(held)


def near_counts(docs: DataFrame, text: str = "text", window: int = 5, seed: int = 42) -> DataFrame:
    """``(a, b, n)``, ``a <= b``: how often two words of a sentence stand within ``window``.

    A task counts :data:`PAIRED` pairs at a time, however long a sentence is, and
    sends them packed by ranges of ``a``, with each id once.
    """
    lines = docs.select(F.explode(X.sentences(text)).alias("_s")).select(_ids(X.words("_s"), seed).alias("_w"))
    cells = max(CELLS, 16 * docs.sparkSession.sparkContext.defaultParallelism)
    counted = lines.where(F.size("_w") > 1).mapInArrow(_line_counts(window, cells), "cell int, size long, data binary")
    return counted.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_counts, "a long, b long, n long")


def near_sums(near: DataFrame) -> DataFrame:
    """``(id, m)``: how many neighbours a word has, each time it stands somewhere."""
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("n").alias("m")), F.struct(F.col("b").alias("id"), F.col("n").alias("m")))
    return near.select(F.inline(ends)).groupBy("id").agg(F.sum("m").alias("m"))


def pmi_entries(near: DataFrame, words: DataFrame, shift: float = 1.0) -> DataFrame:
    """``(v, w, x)``, both ways round: PMI less ``log(shift)``, where positive.

    ``words (id, m, at)``: sums and numbers of the words that take part.
    """
    total = words.agg(F.sum("m")).scalar().cast("double")
    known = near
    for side, at, m in (("a", "v", "mv"), ("b", "w", "mw")):
        known = lookup_join(known, words.select(F.col("id").alias(side), F.col("at").alias(at), F.col("m").alias(m)), [side])
    number = lambda c: F.log(F.col(c).cast("double"))
    same = F.col("v") == F.col("w")  # such a pair is a neighbour at both its ends
    x = number("n") + F.when(same, F.log(F.lit(2.0))).otherwise(0.0) + F.log(total) - number("mv") - number("mw")
    positive = known.select("v", "w", (x - float(np.log(shift))).alias("x")).where(F.col("x") > 0)
    there = F.struct("v", "w", "x")
    back = F.struct(F.col("w").alias("v"), F.col("v").alias("w"), "x")
    return positive.select(F.inline(F.when(same, F.array(there)).otherwise(F.array(there, back))))


class Cells:
    """How a matrix over ``words`` words is cut: groups of rows, one or more a slot, and blocks of columns.

    The whole blocks among the first ``head`` words are the rows of the first
    groups, the slices: each has every so many blocks of columns.
    """

    def __init__(self, words: int, slots: int, block: int = BLOCK, group: int = GROUP, head: int = 0):
        self.words, self.block = words, block
        self.blocks = -(-words // block)
        self.head = min(head, words) // block
        self.slices = min(slots, self.blocks) if self.head else 0
        rest = self.blocks - self.head
        self.group = max(1, min(group, -(-rest // slots)))
        self.groups = self.slices + -(-rest // self.group)

    def rows(self, block: int) -> int:
        return min(self.block, self.words - block * self.block)

    def first(self, group: int) -> int:
        return (self.head + (group - self.slices) * self.group) * self.block if group >= self.slices else 0

    def end(self, group: int) -> int:
        return min(self.first(group + 1), self.words) if group >= self.slices else self.head * self.block

    def of(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group and the block of columns of entries."""
        cb, below = w // self.block, v // self.block - self.head
        return np.where(below < 0, cb % max(self.slices, 1), self.slices + below // self.group), cb

    def columns(self, v: str = "v", w: str = "w") -> tuple[Column, Column]:
        """The same of columns."""
        cb, below = F.floor(F.col(w) / self.block), F.floor(F.col(v) / self.block) - self.head
        return F.when(below < 0, cb % max(self.slices, 1)).otherwise(self.slices + F.floor(below / self.group)), cb

    def over(self, df: DataFrame) -> DataFrame:
        """A task for each group, in order."""
        labels = F.array(*[F.lit(i) for i in bucket_labels(df.sparkSession, self.groups)])
        placed = df.repartition(self.groups, F.element_at(labels, F.col("rg") + 1))
        return placed.sortWithinPartitions("rg", "cb", "n")


PIECE = "rg int, cb int, n int, data binary"
# What ``n`` says of a row that has no entries.
MASK, COLUMNS = -1, 0


def _piece(rg: int, cb: int, n: int, data: bytes) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((rg, cb, n, data), kinds)], ["rg", "cb", "n", "data"])


def _planes(*columns: np.ndarray) -> bytes:
    """Numbers of four bytes, compressed: their first bytes, their second ones and so on."""
    data = b"".join(c.view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return pa.compress(data, "zstd", asbytes=True)


def _unplaned(data: pa.Buffer, n: int) -> np.ndarray:
    """The bytes of three such columns of ``n`` numbers, a row each."""
    raw = pa.decompress(data, 12 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(3, 4, n).transpose(0, 2, 1)).reshape(3, 4 * n)


def _pieces(entries: DataFrame, cells: Cells) -> DataFrame:
    """``(rg, cb, n, data)``: ``n`` entries of a group of rows and a block of columns, packed.

    After them, with :data:`MASK` for ``n``, a bit for each column that has any.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, some = None, None
        for batch in batches:
            v, w, x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rg, cb = cells.of(v, w)
            cuts = [0, *(np.flatnonzero((np.diff(cb) != 0) | (np.diff(rg) != 0)) + 1).tolist(), len(v)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                here = int(rg[low]), int(cb[low])
                if here != at:
                    if at is not None:
                        yield _piece(*at, MASK, np.packbits(some).tobytes())
                    at, some = here, np.zeros(cells.rows(here[1]), bool)
                one = (v[low:high] - cells.first(here[0])).astype("<i4")
                other = (w[low:high] - here[1] * cells.block).astype("<i4")
                some[other] = True
                data = _planes(np.diff(one, prepend=one[:1] * 0), other, x[low:high].astype("<f4"))
                yield _piece(*here, high - low, data)
        if at is not None:
            yield _piece(*at, MASK, np.packbits(some).tobytes())

    rows = entries.select(F.col("v").cast("int"), F.col("w").cast("int"), F.col("x").cast("float"))
    rg, cb = cells.columns()
    return rows.repartition(rg, cb).sortWithinPartitions(rg, cb, "v", "w").mapInArrow(packed, PIECE)


def _row(blocks: list[int], data: list[np.ndarray], name: str = "data") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array([d.astype("<f4").tobytes() for d in data], pa.binary())], ["rb", name]
    )


def _masked(mask: bytes | pa.Buffer, rows: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=rows).astype(bool)


def _sent(block: DataFrame, masks: DataFrame, width: int, cells: Cells) -> DataFrame:
    """The rows of a block ``(rb, data)`` that each group of rows of the matrix needs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                held = np.frombuffer(data.as_buffer(), "<f4").reshape(-1, width)
                for one in wanted.as_py():
                    yield _piece(one["rg"], rb, COLUMNS, one["data"] + held[_masked(one["data"], len(held))].tobytes())

    wanted = masks.groupBy(F.col("cb").alias("rb")).agg(F.collect_list(F.struct("rg", "data")).alias("wanted"))
    return lookup_join(block, wanted, ["rb"]).select("rb", "data", "wanted").mapInArrow(cut, PIECE)


def _times(pieces: DataFrame, block: DataFrame | None, width: int, cells: Cells, seed: int = 0) -> DataFrame:
    """The matrix times a block of columns ``(rb, data)``, or times random signs.

    A task holds the sums of a group of rows and a block of columns; entries
    stream past by block.  Signs are drawn where they are used.  Blocks of the
    head come once for each slice, in parts that :func:`_whole` adds.
    """

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, at, held = None, None, None, None

        def sums() -> Iterator[pa.RecordBatch]:
            for low in range(0, len(total), cells.block):
                yield _row([(cells.first(group) + low) // cells.block], [total[low : low + cells.block]])

        for batch in batches:
            for rg, cb, n, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                data = data.as_buffer()  # not copied: a batch is large
                if rg != group:
                    if group is not None:
                        yield from sums()
                    group, total, at = rg, np.zeros((cells.end(rg) - cells.first(rg), width)), None
                if cb < 0:
                    continue
                if n == COLUMNS:
                    rows = cells.rows(cb)
                    bits = -(-rows // 8)
                    at, held = cb, np.zeros((rows, width), np.float32)
                    held[_masked(data[:bits], rows)] = np.frombuffer(data, "<f4", offset=bits).reshape(-1, width)
                    continue
                if at != cb:
                    at, held = cb, _signs(seed, cb, width, cells)
                raw = _unplaned(data, n)
                v, w, x = np.cumsum(raw[0].view("<i4")), raw[1].view("<i4"), raw[2].view("<f4")
                starts = np.flatnonzero(np.diff(v, prepend=-1))
                total[v[starts]] += np.add.reduceat(held[w] * x[:, None], starts)
        if group is not None:
            yield from sums()

    # a group whose entries are all at or below the shift is there as well
    groups = pieces.sparkSession.range(cells.groups).select(
        F.col("id").cast("int").alias("rg"), F.lit(-1).alias("cb"), F.lit(COLUMNS).alias("n"), F.lit(b"").alias("data")
    )
    every = pieces.where(F.col("n") > 0).unionByName(groups)
    if block is not None:
        masks = stored(pieces.where(F.col("n") == MASK).drop("n"), "masks")
        every = every.unionByName(_sent(block, masks, width, cells))
    return cells.over(every).mapInArrow(multiplied, "rb int, data binary")


def _whole(parts: DataFrame, cells: Cells) -> DataFrame:
    """Blocks ``(rb, data)`` of a stored product: the parts of a head block become one."""
    if not cells.head:
        return parts

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_buffer(), "<f4").astype(float) for d in rows["data"])
        return pa.Table.from_batches([_row([rows["rb"][0].as_py()], [total])])

    head = parts.where(F.col("rb") < cells.head).groupBy("rb").applyInArrow(added, "rb int, data binary")
    return parts.where(F.col("rb") >= cells.head).unionByName(stored(head, "head"))


@lru_cache(maxsize=2)
def _drawn(seed: int, part: int, rows: int, width: int) -> np.ndarray:
    return (2 * np.random.default_rng([seed, part]).integers(0, 2, (rows, width)) - 1).astype(np.float32)


def _signs(seed: int, block: int, width: int, cells: Cells) -> np.ndarray:
    """Random signs, the same whenever a task is run again and however words are cut."""
    first = block * cells.block
    last = first + cells.rows(block)
    parts = range(first // DRAWN, (last - 1) // DRAWN + 1)
    drawn = [_drawn(seed, p, min(DRAWN, cells.words - p * DRAWN), width) for p in parts]
    low = first - parts[0] * DRAWN
    return np.concatenate(drawn)[low : low + last - first]


def _gram(df: DataFrame, left: str, right: str, width: int) -> np.ndarray:
    """``leftᵀ right`` over all blocks: tasks send their own sums, cell by cell."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for pair in zip(*(c.to_pylist() for c in batch.columns)):
                one, other = (np.frombuffer(d, "<f4").reshape(-1, width).astype(float) for d in pair)
                total += one.T @ other
        cells = [pa.array(np.arange(width * width)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(cells, ["i", "x"])

    cells = df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(sums, "i long, x double")
    out = np.zeros(width * width)
    for row in cells.groupBy("i").agg(F.sum("x").alias("x")).collect():  # width² rows
        out[row["i"]] = row["x"]
    return out.reshape(width, width)


def _turned(df: DataFrame, turn: np.ndarray) -> DataFrame:
    """Blocks multiplied by a small matrix from the right."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, data in zip(*(c.to_pylist() for c in batch.columns)):
                yield _row([rb], [np.frombuffer(data, "<f4").reshape(-1, len(turn)) @ turn])

    return df.select("rb", "data").mapInArrow(turned, "rb int, data binary")


def _orthonormal(block: DataFrame, width: int) -> tuple[DataFrame, int]:
    values, axes = np.linalg.eigh(_gram(block, "data", "data", width))
    some = values > max(values.max(), 0.0) * NOISE
    return _turned(block, axes[:, some] / np.sqrt(values[some])), int(some.sum())


def _by_word(df: DataFrame, size: int, block: int) -> DataFrame:
    """``(at, v)``: one row for each word of a block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, data in zip(*(c.to_pylist() for c in batch.columns)):
                flat = np.frombuffer(data, "<f4")
                ends = pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32))
                at = pa.array(np.arange(len(flat) // size, dtype=np.int64) + rb * block)
                yield pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(ends, pa.array(flat))], ["at", "v"])

    return df.mapInArrow(rows, "at long, v array<float>")


def pmi_vectors(
    docs: DataFrame,
    text: str = "text",
    size: int = 100,
    window: int = 5,
    min_count: int = 1,
    shift: float = 1.0,
    rounds: int = 1,
    seed: int = 42,
    near: DataFrame | None = None,
    block_rows: int = BLOCK,
    head: int = HEAD,
) -> DataFrame:
    """``(word, n, v)``: vectors of ``size`` numbers for words that have a neighbour.

    ``rounds`` more multiplications sharpen the leading directions.  Where
    the matrix has fewer than ``size`` of them the rest is 0.  Words rarer than
    ``min_count`` are left out after counting, so windows do not close up over
    them.  ``near``: stored counts, made with ids of the same seed.
    """
    named, used = word_ids(docs, text, seed)
    if near is None:
        near = stored(near_counts(docs, text, window, used), "near-counts")
    elif used != seed:
        raise ValueError(f"two words share an id: count again with seed {used}")
    if min_count > 1:
        keep = named.where(F.col("n") >= min_count)
        for side in ("a", "b"):
            near = lookup_join(near, keep.select(F.col("id").alias(side)), [side], "left_semi")
        near = stored(near, "near-counts")
    known = named.withColumn("rare", F.col("n") < head_cut(named, ["id"], head)).join(near_sums(near), "id")
    words = stored(dense_index(known, ["rare", "id"], "at"), "near-words")
    number, frequent = words.agg(F.count("*"), F.count_if(~F.col("rare"))).first()
    if not number:
        return words.select("word", "n", F.array().cast("array<float>").alias("v"))
    slots = docs.sparkSession.sparkContext.defaultParallelism
    cells = Cells(number, slots, block_rows, head=frequent if frequent < number else 0)
    pieces = stored(_pieces(pmi_entries(near, words, shift), cells), "pmi")
    width = size + EXTRA
    block = _times(pieces, None, width, cells, seed)
    for _ in range(rounds + 1):
        basis, width = _orthonormal(_whole(stored(block, "block"), cells), width)
        if not width:  # no pair is more frequent than the shift
            return words.select("word", "n", F.array_repeat(F.lit(0.0).cast("float"), size).alias("v"))
        block = _times(pieces, basis, width, cells)
    # a product is linear, so the parts of the head need not be added here
    inner = _gram(basis.join(block.select("rb", F.col("data").alias("z")), "rb"), "data", "z", width)
    values, axes = np.linalg.eigh((inner + inner.T) / 2)
    first = np.argsort(-np.abs(values))[:size]
    turn = np.zeros((width, size))
    turn[:, : len(first)] = axes[:, first] * np.sqrt(np.abs(values[first]))
    vectors = _by_word(_turned(basis, turn), size, block_rows)
    return stored(words.select("word", "n", "at").join(vectors, "at").select("word", "n", "v"), "word-vectors")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _units(vectors: DataFrame) -> DataFrame:
    """``(word, v)`` of length 1; words without direction are left out."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = len(batch.column(1)[0])
            rows = _matrix(batch.column(1), size).astype(float)
            norm = np.sqrt((rows * rows).sum(axis=1))
            some = norm > 0
            rows = (rows[some] / norm[some, None]).ravel()
            ends = pa.array(np.arange(0, len(rows) + 1, size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(rows))], ["word", "v"]
            )

    return vectors.select("word", F.col("v").cast("array<double>")).mapInArrow(scaled, "word string, v array<double>")


def _signatures(units: DataFrame, size: int, tables: int, bits: int, seed: int) -> DataFrame:
    """``(word, sigs)``: for each table, on which sides of its hyperplanes a word lies."""
    planes = np.random.default_rng(seed).standard_normal((size, tables * bits))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (_matrix(batch.column(1), size) @ planes > 0).reshape(batch.num_rows, tables, bits)
            marks = (sides @ powers).ravel()
            ends = pa.array(np.arange(0, len(marks) + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(marks))], ["word", "sigs"]
            )

    return units.mapInArrow(signed, "word string, sigs array<long>")


def nearest_words(
    vectors: DataFrame,
    targets: DataFrame,
    k: int = 10,
    tables: int = 24,
    per_cell: int = 64,
    seed: int = 7,
) -> DataFrame:
    """``(target, rank, word, cosine)``: the nearest words of each of ``targets (word)``.

    Candidates share a cell of a table with the target, or lie in a cell that
    one hyperplane parts from its own.  A table has so many cells that one
    holds ``per_cell`` words on average, so a target meets a number of words
    that grows with the logarithm of the vocabulary.  All candidates are ranked
    by exact cosine; ties go by word.  Targets without a vector have no row.
    Vectors stay where they are, as long as the pairs to rank are few; they are
    read four times, so pass them stored.
    """
    units = _units(vectors)
    shape = units.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    bits = int(min(40, max(0, round(np.log2(max(shape["n"], 1) / per_cell)))))
    if not shape["n"]:
        return units.select(F.col("word").alias("target"), F.lit(0).alias("rank"), "word", F.lit(0.0).alias("cosine"))
    wanted = targets.select("word").distinct()
    signed = stored(_signatures(units, shape["d"], tables, bits, seed), "signatures")
    cells = signed.select("word", F.posexplode("sigs").alias("t", "sig"))
    flips = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(bits))]])
    asked = (
        lookup_join(cells, wanted, ["word"], "left_semi")
        .withColumn("flip", F.explode(flips))
        .select(F.col("word").alias("target"), "t", F.col("sig").bitwiseXOR(F.col("flip")).alias("sig"))
    )
    # cells of the whole vocabulary stay where they are, as long as those asked for are few
    pairs = lookup_join(cells, stored(asked, "asked-cells"), ["t", "sig"]).select("target", "word").distinct()
    asked_units = lookup_join(units, wanted, ["word"], "left_semi").select(F.col("word").alias("target"), F.col("v").alias("u"))
    pairs = stored(pairs.where(F.col("word") != F.col("target")), "near-pairs")
    few = fits_broadcast(pairs, PAIRS)
    near = lookup_join(units.join(F.broadcast(pairs) if few else pairs, "word"), asked_units, ["target"])
    cosine = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("cosine"), "word"))
    return (
        near.select("target", "word", cosine.alias("cosine"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("target", "rank", "word", "cosine")
    )


def similar_words(vectors: DataFrame, target: str, k: int = 10) -> DataFrame:
    """``(word, similarity)``: the ``k`` nearest words of one target, from all words."""
    units = _units(vectors)
    one = units.where(F.col("word") == target).select(F.col("v").alias("u"))
    cosine = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (
        units.where(F.col("word") != target)
        .withColumn("u", one.scalar())
        .select("word", cosine.alias("similarity"))
        .where(F.col("similarity").isNotNull())
        .orderBy(F.desc("similarity"), "word")
        .limit(k)
    )
