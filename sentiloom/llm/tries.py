"""The tree of all conversation prefixes, from adaptive radix trees over turn ids.

A turn's id is sixteen bytes, big-endian, of its role and text; a conversation
is the ids of its turns one after the other.  Tasks build radix trees over as
many conversations as they hold and send the totals of each byte depth that is
the end of a turn; equal prefixes meet by a key.  No group holds more than 256
turns, whatever the length of a conversation: it is cut into chunks, and a
chunk's keys begin with the key of the prefix before it.

What is asked of subtrees adds up over conversations, so no level of the tree
waits for another.  The owner of a node is its smallest member, and a
conversation owns what lies from some depth on.  In the tokens that a subtree
saves, its members count with their turns down to that depth, and its leaves
are those members' that own one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.llm.common import quoted, store
from sentiloom.llm.radix import Tree
from sentiloom.operators.scale import dense_index

#: Bytes of a turn's id.
WIDTH = 16
#: Turns in a chunk, and chunks, or groups of them, whose totals are summed in one group.
CHUNK = 256
#: A task sends what it has and starts a new tree after so many turns.
TURNS_IN_TREE = 1 << 18


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv_id, pos, id, cp)``: places from 0 in the order of turn (null first), role and id."""
    own = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    known = df.select(quoted(conv).cast("long").alias("conv_id"), quoted(turn).alias("turn"), own(role).alias("role"), own(text).alias("text"))
    marked = known.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("id"),
        F.length("text").cast("long").alias("cp"),
    )
    return dense_index(marked, ["conv_id", "turn", "role", "id"], "idx")


def rebuilt(placed: DataFrame, family: int, most: int, size: int = CHUNK) -> DataFrame:
    """Chunks ``(conv_id, chunk, length, turns)`` of conversations with their family's first turns.

    ``turns`` are ``(depth, id, cp)`` in order, depths from 1.  A conversation
    gives up its first h turns, h = crc32(conv_id) mod ``most``, for as many of
    those of conversation ``conv_id - conv_id % family`` as there are.
    """
    sizes = placed.groupBy("conv_id").agg(F.min("idx").alias("first"), F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = sizes.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.where("conv_id = base").select("base", F.col("own").alias("base_own"))
    head = F.least("h", F.coalesce("base_own", F.lit(0).cast("long")))
    convs = store(
        sizes.join(bases, "base", "left").select(
            "conv_id", "first", "h", "base", head.alias("head"), (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + head).alias("length")
        ),
        "conversations",
    )
    at = placed.join(convs, "conv_id").withColumn("pos", F.col("idx") - F.col("first"))
    own = at.where("pos >= h").select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("head") + 1).alias("depth"), "id", "cp")
    heads = at.where(f"conv_id = base AND pos < {most - 1}").select("base", "pos", "id", "cp")
    lent = convs.where("head > 0").join(heads, "base").where("pos < head").select("conv_id", "length", (F.col("pos") + 1).alias("depth"), "id", "cp")
    bare = convs.where("length = 0").select(
        "conv_id", "length", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("cp")
    )
    one = F.when(F.col("depth").isNotNull(), F.struct("depth", "id", "cp"))
    chunk = F.coalesce(F.floor((F.col("depth") - 1) / size), F.lit(0)).alias("chunk")
    grouped = own.union(lent).union(bare).groupBy("conv_id", chunk, "length").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return store(grouped, "chunks")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one; the constants are fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """The turns of many chunks in a row: keys of the prefixes they end, and tokens so far.

    A prefix's key combines, per 64-bit half, what each turn's id and depth are
    mixed to, so that chunks can be keyed from the totals of those before them.
    """

    def __init__(self, batch: pa.RecordBatch):
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.conv, self.chunk = col["conv_id"].to_numpy(), col["chunk"].to_numpy()
        self.length = col["length"].to_numpy()
        lists = col["turns"]
        flat = lists.flatten()
        self.size = lists.value_lengths().to_numpy()
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.depth, self.cp = flat.field(0).to_numpy(), flat.field(2).to_numpy()
        self.ids = b"".join(flat.field(1).to_pylist())
        halves = np.frombuffer(self.ids, ">u8").reshape(-1, 2).astype(np.uint64)
        step = _mixed(self.depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.step = np.stack([_mixed(halves[:, 0] + step), _mixed(halves[:, 1] ^ step)], axis=1)
        if "x1" in col:
            start = [col[c].to_numpy().astype(np.int64) for c in ("x1", "x2", "t")]
            self.start = np.stack([s.view(np.uint64) for s in start[:2]], axis=1)
            self.all = col["all_t"].to_numpy()
        else:
            start = [np.zeros(len(self.conv), np.int64)] * 3
            self.start = np.zeros((len(self.conv), 2), np.uint64)
            self.all = None
        before = np.concatenate([np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(self.step)])
        tokens = np.concatenate([[0], np.cumsum(self.cp)])
        row = np.repeat(np.arange(len(self.conv)), self.size)
        self.row, self.key = row, before[1:] ^ before[self.at[row]] ^ self.start[row]
        self.tokens = tokens[1:] - tokens[self.at[row]] + start[2][row]
        ended = tokens[self.at[1:]] - tokens[self.at[:-1]]
        self.sums = np.bitwise_xor(before[self.at[1:]], before[self.at[:-1]]), ended
        if self.all is None:
            self.all = ended
        self.owner = [col[c].to_numpy() for c in ("o", "w", "leaf")] if "o" in col else None

    def path(self, i: int, n: int | None = None) -> bytes:
        """The bytes of chunk ``i``: the key before it, then its first ``n`` turns' ids."""
        end = self.at[i + 1] if n is None else self.at[i] + n
        return self.start[i].astype(">u8").tobytes() + self.ids[self.at[i] * WIDTH : end * WIDTH]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _spelled(batch: Batch, tree: Tree, columns: Callable) -> pa.RecordBatch:
    """A row for each turn-aligned byte depth of the tree.

    ``columns(turn, value)`` makes the rows of the nodes that end turns ``turn``
    of the batch; the root of all is numbered -1.
    """
    places, number, values = [], [], []
    for row, begin, end, value in tree.nodes():
        for_start = begin < WIDTH <= end and batch.chunk[row] == 0
        low = batch.at[row] + max(begin // WIDTH, 1) - 1
        high = batch.at[row] + end // WIDTH - 1
        if for_start:
            places.append([-1])
        if high > low:
            places.append(range(low, high))
        number.append(for_start + max(high - low, 0))
        values.append(value)
    turn = np.concatenate([np.asarray(p, np.int64) for p in places])
    return columns(turn, np.repeat(np.array(values, np.int64), number, axis=0))


def _scanned(chunks: list[DataFrame], combine: Callable, values: Callable, columns: Callable, fields: str) -> DataFrame:
    """Radix trees over chunks; ``values(batch, i)`` gives keys' turns and values of chunk ``i``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            begin, sizes = 0, whole.column(whole.schema.get_field_index("turns")).value_lengths().to_numpy()
            while begin < whole.num_rows:
                end = begin + 1 + int(np.searchsorted(np.cumsum(sizes[begin:] + 1), TURNS_IN_TREE))
                batch, tree = Batch(whole.slice(begin, end - begin)), Tree(combine)
                for i in range(len(batch.conv)):
                    for n, value in values(batch, i):
                        tree.insert(batch.path(i, n), i, value)
                if tree.root is not None:
                    yield _spelled(batch, tree, columns(batch))
                begin = end

    parts = [c.mapInArrow(run, fields) for c in chunks]
    return parts[0].union(parts[1])


def _key_columns(batch: Batch, turn: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
    """``k1, k2`` of nodes, ``p1, p2`` of their parents (null at the root); and who is the root."""
    root = turn < 0
    if not len(batch.key):
        none = pa.array([None] * len(turn), pa.int64())
        zero = pa.array([0] * len(turn), pa.int64())
        return [zero, zero, none, none], root
    at = np.where(root, 0, turn)
    key = np.where(root[:, None], np.uint64(0), batch.key[at])
    begins = batch.at[batch.row[at]] == at
    parent = np.where(begins[:, None], batch.start[batch.row[at]], batch.key[at - 1])
    own = [_signed(key[:, i]) for i in (0, 1)]
    above = [pa.array(np.ascontiguousarray(parent[:, i]).view(np.int64), pa.int64(), mask=root) for i in (0, 1)]
    return own + above, root


def _of_turn(column: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The column at the turns, 0 at the root."""
    return np.where(turn < 0, 0, column[np.maximum(turn, 0)]) if len(column) else np.zeros(len(turn), np.int64)


def node_counts(chunks: list[DataFrame]) -> DataFrame:
    """Every node once: ``k1, k2, p1, p2, depth, cp, t, n_convs, conv_id``; t are tokens from the root."""

    def columns(batch):
        def make(turn, value):
            keys, _ = _key_columns(batch, turn)
            own = [_of_turn(c, turn) for c in (batch.depth, batch.cp, batch.tokens)]
            arrays = keys + [pa.array(c, pa.int64()) for c in (*own, value[:, 0], value[:, 1])]
            return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "p1", "p2", "depth", "cp", "t", "n_convs", "conv_id"])

        return make

    combine = lambda a, b: (a[0] + b[0], min(a[1], b[1]))
    values = lambda batch, i: [(None, (1, int(batch.conv[i])))]
    fields = "k1 long, k2 long, p1 long, p2 long, depth long, cp long, t long, n_convs long, conv_id long"
    same = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "cp", "t")]
    parts = _scanned(chunks, combine, values, columns, fields)
    return parts.groupBy("k1", "k2").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def subtree_sums(chunks: list[DataFrame], size: int = CHUNK) -> DataFrame:
    """``k1, k2, saved, leaves`` in parts, from chunks with the ``o, w, leaf`` of their conversation.

    A conversation counts as far as the depth before ``o``, from which on it
    owns its nodes: there it adds ``w``, its tokens so far, and every node
    above takes off those before itself.
    """

    def values(batch, i):
        before = int(batch.chunk[i]) * size
        o, w, leaf = batch.owner[0][i], batch.owner[1][i], batch.owner[2][i]
        least = None if o < 0 else max(0, min(int(o) - 1 - before, int(batch.size[i])))
        total = int(batch.all[i] if o < 0 else w)
        if least is None or least > 0 or (before == 0 and o > 0):
            yield least, (1, total, 0)
        if leaf:
            yield None, (0, 0, 1)

    def columns(batch):
        def make(turn, value):
            keys, root = _key_columns(batch, turn)
            before = _of_turn(batch.tokens, turn) - _of_turn(batch.cp, turn)
            saved = value[:, 1] - value[:, 0] * before
            arrays = [*keys[:2], pa.array(saved, pa.int64()), pa.array(value[:, 2], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "saved", "leaves"])

        return make

    combine = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    return _scanned(chunks, combine, values, columns, "k1 long, k2 long, saved long, leaves long")


def chunk_sums(chunks: DataFrame) -> DataFrame:
    """``(conv_id, chunk, x1, x2, t)``: what a chunk adds to keys and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = Batch(whole)
            x, t = batch.sums
            arrays = [pa.array(batch.conv), pa.array(batch.chunk), _signed(x[:, 0]), _signed(x[:, 1]), pa.array(t, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "chunk", "x1", "x2", "t"])

    return chunks.mapInArrow(run, "conv_id long, chunk long, x1 long, x2 long, t long")


def running(sums: DataFrame, last: int, size: int = CHUNK) -> DataFrame:
    """The same columns, summed over a conversation's earlier chunks.

    Groups of ``size`` chunks are summed up within, their totals by the same rule,
    so that no group grows with the conversation.
    """
    of = lambda c: F.bit_xor(c) if c != "t" else F.sum(c)
    names = ("x1", "x2", "t")
    grouped = sums.withColumn("group", F.floor(F.col("chunk") / size))
    earlier = Window.partitionBy("conv_id", "group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.select("conv_id", "group", "chunk", *[F.coalesce(of(c).over(earlier), F.lit(0)).alias(c) for c in names])
    if last < size:
        return within.drop("group")
    totals = grouped.groupBy("conv_id", F.col("group").alias("chunk")).agg(*[of(c).alias(c) for c in names])
    above = running(totals, last // size, size).select("conv_id", F.col("chunk").alias("group"), *[F.col(c).alias(f"above_{c}") for c in names])
    both = lambda c: F.col(c).bitwiseXOR(F.col(f"above_{c}")) if c != "t" else F.col(c) + F.col(f"above_{c}")
    return within.join(above, ["conv_id", "group"]).select("conv_id", "chunk", *[both(c).alias(c) for c in names])


def keyed(chunks: DataFrame, size: int = CHUNK) -> list[DataFrame]:
    """Chunks of conversations of one chunk; and those of longer ones with what comes before them."""
    long = chunks.where(f"length > {size}")
    sums = store(chunk_sums(long), "chunk-sums")
    last = sums.agg(F.max("chunk")).first()[0] or 0
    whole = sums.groupBy("conv_id").agg(F.sum("t").alias("all_t"))
    carry = store(running(sums, last, size).join(whole, "conv_id"), "chunk-keys")
    return [chunks.where(f"length <= {size}"), long.join(carry, ["conv_id", "chunk"])]


def ends(chunks: list[DataFrame], size: int = CHUNK) -> DataFrame:
    """``(k1, k2, conv_id)``: the node at which each conversation ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = Batch(whole)
            last = np.flatnonzero(batch.chunk * size + batch.size == batch.length)
            end = batch.start ^ batch.sums[0]
            yield pa.RecordBatch.from_arrays(
                [_signed(end[last, 0]), _signed(end[last, 1]), pa.array(batch.conv[last])], names=["k1", "k2", "conv_id"]
            )

    parts = [c.mapInArrow(run, "k1 long, k2 long, conv_id long") for c in chunks]
    return parts[0].union(parts[1])


def digests(ended: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of the ids in ascending order, joined by commas.

    A hash takes its bytes in one order, so the ids of one node pass through
    one task; they are sorted on disk and hashed as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if (k1, k2) == at:
                    state.update(f",{conv}".encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (k1, k2), hashlib.sha256(str(conv).encode())
            if out:
                yield _rows(out)
        if at is not None:
            yield _rows([(*at, state.hexdigest())])

    def _rows(out: list) -> pa.RecordBatch:
        a, b, c = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], names=["k1", "k2", "ends_sha256"])

    placed = ended.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return placed.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_tree(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    family: int = 100,
    most: int = 6,
    size: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """The nodes of the tree of rebuilt conversations, and where each conversation ends.

    Nodes are ``(k1, k2, p1, p2, conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens)``, ``k1, k2`` the key of the node and
    ``p1, p2`` of its parent (null at the root); the ends are ``(k1, k2,
    conv_id)``.  See :func:`rebuilt` for what ``family`` and ``most`` do;
    ``size`` is that of chunks.

    Turns are ordered by ``turn``, null first, of equal ones by role, then by
    the hash of role and text; repeated rows are turns of their own.  A null
    role or text is an empty one.  Rows with a null ``conv`` belong to no
    conversation and are left out.  A conversation that has lost all its turns
    is a member of the root only.  Conversations and texts may be of any
    length.  An empty table has no nodes.
    """
    chunks = rebuilt(turns(df, conv, turn, role, text), family, most, size)
    pieces = keyed(chunks, size)
    nodes = store(node_counts(pieces), "trie-nodes")
    kids = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = store(nodes.join(kids, ["k1", "k2"], "left").na.fill(0, ["n_children"]), "trie-nodes")
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("o"), F.min_by(F.col("t") - F.col("cp"), "depth").alias("w"), F.max(F.col("n_children") == 0).cast("long").alias("leaf")
    )
    known = [p.join(owners, "conv_id", "left").na.fill(-1, ["o"]).na.fill(0, ["w", "leaf"]) for p in pieces]
    own = ["k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "n_children"]
    none: Callable[[str], Column] = lambda c: F.lit(None).cast("long").alias(c)
    parts = nodes.select(*own, none("saved"), none("leaves")).union(
        subtree_sums(known, size).select("k1", "k2", *[none(c) for c in own[2:]], "saved", "leaves")
    )
    whole = parts.groupBy("k1", "k2").agg(
        *[F.max(c).alias(c) for c in own[2:]], F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    shown = whole.join(parents, ["p1", "p2"], "left").select(
        *own[:6], "parent_conv_id", *own[6:], "n_leaves", "saved_tokens"
    )
    return shown, ends(pieces, size)
