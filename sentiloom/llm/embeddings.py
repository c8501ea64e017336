"""Near duplicates among embeddings by quantisation.

Unit vectors go to coarse inverted lists, and their coordinates along the
sample's leading axes are coded as small whole numbers.  A vector looks into
every list whose cell may hold one of its near neighbours, the codes bound the
distances there from below, a product of matrices at a time, and what they
leave gets exact cosines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import quoted, store
from sentiloom.llm.components import components

THRESHOLD = 0.9
#: Centres and codes are fitted on so many vectors, the first by a hash.
SAMPLE = 1 << 15
#: Codes lie within plus and minus this.
CODES = 127
#: All lists that can hold a neighbour are probed.  A finite number probes those
#: within so many deviations of an offset that is alike in all dimensions, and
#: loses links where vectors have fewer dimensions than numbers.
DEVIATIONS = float("inf")
#: Vectors of a list or its visitors that one comparison holds: an eighth of all
#: vectors, but no fewer than the first and no more numbers than the second.
BLOCK, NUMBERS = 2048, 1 << 22
#: Visitors and homes whose pairs are looked at together.
TILE = (256, 2048)
#: What a row that moves costs, and a pair that the codes leave, in pairs of codes.
ROW, EXACT = 3000, 150


@dataclass
class Index:
    centres: np.ndarray  # lists, d
    axes: np.ndarray  # d, coded coordinates: orthonormal
    step: float  # of the codes
    threshold: float
    deviations: float
    block: int

    @property
    def radius(self) -> float:
        """The distance of unit vectors at the threshold."""
        return float(np.sqrt(2 - 2 * self.threshold))


def usable(vector: list[float] | None, size: int, kind: str) -> bytes | None:
    """The vector's bytes; None unless all numbers are finite and one is not zero."""
    if vector is None or len(vector) != size or any(x is None for x in vector):
        return None
    v = np.array(vector, kind) + 0.0  # no negative zeros, so that equal vectors have equal bytes
    return v.astype(kind).tobytes() if np.isfinite(v).all() and v.any() else None


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres from a fixed start; an empty one stays where it was."""
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(x[i : i + 4096], centres) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("kd,kd->k", centres, centres) - 2 * x @ centres.T).argmin(axis=1)


def _axes(x: np.ndarray, radius: float) -> np.ndarray:
    """Leading axes of the vectors, as many as make a pair's comparison cheapest.

    More of them take longer for every pair, fewer leave more pairs to the
    exact cosine.
    """
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    some = np.random.default_rng(5).permutation(len(x))[:2048]
    a, b = np.array_split(x[some] @ axes, 2)
    apart, cost = np.zeros((len(a), len(b))), {}
    for i in range(0, x.shape[1], 8):
        p, q = a[:, i : i + 8], b[:, i : i + 8]
        apart += (p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1) - 2 * p @ q.T
        k = min(i + 8, x.shape[1])
        cost[k] = (20 + k) / 44 + (EXACT * (apart <= radius**2).mean() if apart.size else 0)
    return axes[:, : min(cost, key=cost.get)]


def _lists(x: np.ndarray, n: int, most: int, index: Index) -> int:
    """The number of lists, ``most`` at most, with which ``n`` vectors are compared soonest.

    Where cells tell vectors apart, more lists leave fewer pairs; where nearly
    every list has to be probed, they only add rows.
    """
    x = x[np.random.default_rng(7).permutation(len(x))[: 1 << 13]]
    cost, lists = {}, 1
    while lists <= max(1, min(most, len(x) // 16)):
        share = probes(x[:2048], replace(index, centres=k_means(x, lists, 4))).mean() if lists > 1 else 1.0
        met = share * n / 2 + n / lists / 2
        cost[lists] = met + ROW * (np.ceil(met / index.block) + share * lists / 2 * np.ceil(n / lists / index.block))
        lists *= 8 if lists == 1 else 4
    best = min(cost, key=cost.get)
    return most if best == max(cost) > 1 else best


def train(x: np.ndarray, n: int, lists: int | None, threshold: float, deviations: float, block: int | None = None) -> Index:
    """The index of ``n`` vectors from a sample of them."""
    block = block or max(BLOCK, min(n // 8, NUMBERS // x.shape[1]))
    index = Index(x[:1], np.eye(x.shape[1]), 1.0, threshold, deviations, block)
    axes = _axes(x, index.radius)
    index = replace(index, axes=axes, step=float(np.abs(x @ axes).max()) / CODES)
    most = max(1, min(lists or int(np.ceil(np.sqrt(n))), len(x) // 16))
    return replace(index, centres=k_means(x, most if lists else _lists(x, n, most, index)))


def encode(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the leading coordinates, and how far the coded point is off."""
    at = x @ index.axes
    codes = np.clip(np.rint(at / index.step), -CODES, CODES).astype(np.int8)
    return codes, np.sqrt(((at - codes * index.step) ** 2).sum(axis=1))


def probes(x: np.ndarray, index: Index) -> np.ndarray:
    """Which lists (columns) may hold neighbours of each vector (rows).

    A neighbour lies in a cell only if it crosses the plane halfway between
    the cell's centre and the vector's own; a cell is probed if that plane is
    within the radius of the threshold, so that none is lost, or within
    ``deviations`` if these are finite.
    """
    c = index.centres
    square = np.einsum("kd,kd->k", c, c)
    far = square - 2 * x @ c.T
    own = far.argmin(axis=1)
    apart = np.sqrt(np.maximum(square[own][:, None] + square[None, :] - 2 * c[own] @ c.T, 0))
    reach = index.radius * min(1.0, index.deviations / np.sqrt(x.shape[1]))
    ahead = far - far[np.arange(len(x)), own][:, None]
    return ahead <= 2 * reach * apart + 1e-9


def hosts(own: np.ndarray, lists: int) -> np.ndarray:
    """Of two lists one receives the other's vectors: which (columns) receive those of ``own`` (rows)."""
    cell = np.arange(lists)[None, :]
    return (cell == own[:, None]) | (((cell + own[:, None]) % 2 == 0) == (cell > own[:, None]))


def sides(codes: np.ndarray, off: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of matrices whose product is not negative where codes may belong to near vectors.

    Near vectors are within the radius along the axes too, so their coded
    points within ``radius + off + off``.  Its square is at most
    ``radius**2 + 2 * radius * (off + off) + 2 * off**2 + 2 * off**2``, a sum of
    what either side knows of itself; the slack is for single precision.
    """
    at = codes * index.step
    slack = 1e-6 * (at.shape[1] + 4)
    far = ((at**2).sum(axis=1) - index.radius**2 / 2 - 2 * index.radius * off - 2 * off**2) / 2 - slack
    one = np.ones(len(at))
    columns = np.zeros((at.shape[1] + 2, -(-len(at) // 8) * 8), np.float32)
    columns[-1] = -1  # those that fill up to eights are near nothing
    columns[:, : len(at)] = np.vstack([at.T, one, -far])
    return np.column_stack([at, -far, one]).astype(np.float32), columns


def compare(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of ``x`` and ``y``, whose :func:`sides` are ``rows`` and ``columns``."""
    may = rows @ columns >= 0
    some = np.flatnonzero(may.view(np.uint64) != 0)  # eight pairs at once: few are left
    if len(some) > may.size // 20:
        return np.nonzero(may[:, : len(y)] & (x @ y.T >= index.threshold))
    eight, at = np.nonzero(may.reshape(-1, 8)[some])
    a, b = np.divmod(some[eight] * 8 + at, may.shape[1])
    ok = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        p, q = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
        ok[i : i + len(p)] = np.einsum("nd,nd->n", x[p], y[q]) >= index.threshold
    return a[ok], b[ok]


def _forest(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects: one row's walk at a time."""
    out, open_a, open_b = [], near.any(axis=1), near.any(axis=0)
    for s in np.flatnonzero(open_a):
        if not open_a[s]:
            continue
        front = [s]
        open_a[s] = False
        while front:
            i = front.pop()
            cols = np.flatnonzero(near[i] & open_b)
            open_b[cols] = False
            out.extend((a[i], b[j]) for j in cols)
            for j in cols:
                rows = np.flatnonzero(near[:, j] & open_a)
                open_a[rows] = False
                out.extend((a[r], b[j]) for r in rows)
                front.extend(rows)
    return [(int(p), int(q)) for p, q in out if p != q]


def _unpack(raw: list[bytes], kind: str, rows: int | None = None) -> np.ndarray:
    """Unit vectors in double precision, from the bytes of numbers as they were given."""
    rows = len(raw) if rows is None else rows
    if not rows:
        return np.zeros((0, 0))
    x = np.frombuffer(b"".join(raw), kind).reshape(rows, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


class _Roots(dict):
    """Ids and what connects them so far."""

    def root(self, i: int) -> int:
        while (up := self.get(i, i)) != i:
            self[i] = i = self.get(up, up)
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart; now they are not."""
        i, j = self.root(i), self.root(j)
        self[max(i, j)] = min(i, j)
        return i != j


def links(vectors: DataFrame, index: Index, kind: str = "<f8") -> DataFrame:
    """What comparisons find among distinct vectors ``(id, copies, vector)``.

    Rows ``(a, b, n)``: with a null ``b``, vector ``a`` has links to ``n``
    vectors, copies counted, in one comparison; else a link, as many as keep
    each comparison's components together.  Every vector is in one list and
    visits those that :func:`probes` and :func:`hosts` name; a link between two
    lists is found in one of them and counted for both its ends.  Lists and
    visitors are dealt into blocks by their counts, so that no comparison grows
    with a list; vectors that go the same way travel in one row.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(index)
    lists = len(index.centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Slices of ids, copies and raw vectors; the own list of each, and which vector goes to which list."""
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                raw = part.column(2).to_pylist()
                x = _unpack(raw, kind)
                own = _nearest(x, shared.value.centres)
                at = probes(x, shared.value)
                at[np.arange(len(x)), own] = True
                yield part.column(0).to_numpy(), part.column(1).to_numpy(), raw, own, *np.nonzero(at & hosts(own, lists))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visits = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
        for _, _, _, own, _, cell in placed(batches):
            homes += np.bincount(own, minlength=lists)
            visits += np.bincount(cell, minlength=lists)
        some = np.flatnonzero(visits)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(homes[some]), pa.array(visits[some])], names=["cell", "homes", "visits"])

    homes, visits = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    sized = vectors.select("id", "copies", "vector").mapInArrow(count, "cell long, homes long, visits long")
    for cell, at_home, there in sized.groupBy("cell").agg(F.sum("homes"), F.sum("visits")).collect():  # a row for each list
        homes[cell], visits[cell] = -(-at_home // index.block), -(-there // index.block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "h", "v", "home", "ids", "copies", "guest", "vectors"]
        for ids, copies, raw, own, row, cell in placed(batches):
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
            raw = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            parts = []
            for is_home, times in ((True, np.where(cell == own[row], visits[cell], 0)), (False, homes[cell])):
                times = np.where(homes[cell] > 0, times, 0)
                at = np.repeat(np.arange(len(row)), times)
                each = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                r, c = row[at], cell[at]
                h, v = (mixed[r] % homes[c], each) if is_home else (each, mixed[r] % visits[c])
                parts.append(np.column_stack([c, h, v, np.full(len(c), is_home), r]))
            ways = np.concatenate(parts)
            ways = ways[np.lexsort(ways.T[::-1])]
            starts = np.flatnonzero(np.r_[True, (ways[1:, :4] != ways[:-1, :4]).any(axis=1)]) if len(ways) else []
            out, size = [], 0
            for way in np.split(ways, starts[1:]) if len(ways) else []:
                c, h, v, is_home, _ = way[0].tolist()
                r = way[:, 4]
                guest = (own[r] != c) & (not is_home)
                out.append((c, h, v, bool(is_home), ids[r].tobytes(), copies[r].tobytes(), guest.tobytes(), raw[r].tobytes()))
                size += len(out[-1][-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)

    def meet(key, table):
        index = shared.value
        sets = []
        for part in (table.filter(pc.invert(table.column("home"))), table.filter(table.column("home"))):
            ids, copies, guest = (np.frombuffer(b"".join(part.column(x).to_pylist()), t) for x, t in (("ids", "<i8"), ("copies", "<i8"), ("guest", "?")))
            sets.append((ids, copies.astype(np.float64), guest, _unpack(part.column("vectors").to_pylist(), kind, len(ids))))
        (a, from_a, guest, x), (b, from_b, _, y) = sets
        from_a = from_a * guest
        n, m = np.zeros(len(a)), np.zeros(len(b))
        roots, pairs = _Roots(), []
        if len(a) and len(b):
            rows, columns = sides(*encode(x, index), index)[0], sides(*encode(y, index), index)[1]
            for i in range(0, len(a), TILE[0]):
                here = slice(i, i + TILE[0])
                for j in range(0, len(b), TILE[1]):
                    there = slice(j, j + TILE[1])
                    p, q = compare(x[here], y[there], rows[here], columns[:, there], index)
                    other = a[here][p] != b[there][q]
                    p, q = p[other], q[other]
                    if not len(p):
                        continue
                    n[here] += np.bincount(p, from_b[there][q], len(n[here]))
                    m[there] += np.bincount(q, from_a[here][p], len(m[there]))
                    at_p, at_q = np.unique(p), np.unique(q)
                    near = np.zeros((len(at_p), len(at_q)), bool)
                    near[np.searchsorted(at_p, p), np.searchsorted(at_q, q)] = True
                    pairs += [link for link in _forest(a[here][at_p], b[there][at_q], near) if roots.join(*link)]
        n, ids = np.concatenate([n, m]), np.concatenate([a, b])
        some = np.flatnonzero(n)
        out_a = [*ids[some].tolist(), *(p for p, _ in pairs)]
        out_b = [*[None] * len(some), *(q for _, q in pairs)]
        out_n = [*n[some].astype(np.int64).tolist(), *[0] * len(pairs)]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})

    dealt = vectors.select("id", "copies", "vector").mapInArrow(
        deal, "cell long, h long, v long, home boolean, ids binary, copies binary, guest binary, vectors binary"
    )
    return dealt.groupBy("cell", "h", "v").applyInArrow(meet, "a long, b long, n long")


def fit(
    vectors: DataFrame,
    kind: str = "<f8",
    threshold: float = THRESHOLD,
    lists: int | None = None,
    deviations: float = DEVIATIONS,
    sample: int = SAMPLE,
    block: int | None = None,
) -> Index | None:
    """Centres and axes from about ``sample`` distinct vectors, chosen by their hash.

    The number of lists follows the square root of the number of vectors, as
    far as the sample gives 16 vectors for each, or is smaller if the sample
    says that cells leave most pairs; lists that grow are dealt into more blocks.
    """
    n = vectors.count()
    if not n:
        return None
    share = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < max(1, int(min(1.0, sample / n) * (1 << 30)))
    x = _unpack(vectors.where(share).select("vector").limit(2 * sample).toArrow().column("vector").to_pylist(), kind)
    if not len(x):  # few vectors, and none of them by chance
        x = _unpack(vectors.select("vector").limit(1).toArrow().column("vector").to_pylist(), kind)
    x = x[np.lexsort(x.T)]
    return train(x, n, lists, threshold, deviations, block)


def near_duplicates(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    lists: int | None = None,
    deviations: float = DEVIATIONS,
    block: int | None = None,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per vector.

    Links are pairs of cosine ``threshold`` or more, in double precision.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is
    the smallest id reachable, ``kept`` says that it is the vector's own.
    Equal vectors are compared once and counted as often as they occur, and
    dense groups send counts and a few connecting links, not their pairs.  A
    vector that is null, empty or zero, holds nulls or numbers that are not
    finite, or has not the length most rows have (the smallest of several) is
    linked with nothing.  An id must not be null; repeated ids are vectors of
    their own, linked if alike.
    """
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    numbers = "array<float>" if kind == "<f4" else "array<double>"
    ids = df.select(quoted(vec_id).cast("long").alias("id"), quoted(vector).cast(numbers).alias("vector"))
    sizes = ids.where("size(vector) > 0").groupBy(F.size("vector").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), "size").first()
    usual = usual[0] if usual else 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [usable(v, usual, kind) for v in batch.column(1).to_pylist()]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], names=["id", "vector", "key"]
            )

    rows = store(ids.mapInArrow(normal, "id long, vector binary, key binary"), "units")
    valid = rows.where("key IS NOT NULL")
    same = valid.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    distinct = store(same.withColumn("id", F.monotonically_increasing_id()), "distinct")
    index = fit(distinct, kind, threshold, lists, deviations, block=block)
    lone = rows.where("key IS NULL").select(
        F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    if index is None:
        return lone.withColumn("kept", F.lit(True))
    found = store(links(distinct, index, kind), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"), name="vector-components")
    known = (
        distinct.select("key", "id", "least", "copies")
        .join(counts, "id", "left")
        .join(roots, "id", "left")
        .select(
            "key",
            "least",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    whole = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(whole, "component").select("key", "n_links", "component_id")
    linked = valid.select("key", F.col("id").alias("vec_id")).join(known, "key").select("vec_id", "n_links", "component_id")
    return linked.union(lone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
