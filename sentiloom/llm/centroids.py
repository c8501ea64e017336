"""Centroid clustering of integer vectors by tables of squared differences.

Components are integers, and few different ones occur.  So each round tabulates,
for every dimension and every integer that occurs in it, the squared difference
to each centroid; the distance of a vector is a sum of table entries, gathered
by numpy.  All sums are exact, so the result does not depend on how rows are
dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sentiloom.llm.common import packed, quoted, store

#: Vectors whose integers share one dictionary per dimension; codes have 16 bits.
BLOCK = 8192
LARGEST = (1 << 63) - 1


def usable(vector: Column, dims: int, scale: float) -> Column:
    """``dims`` components, none null, NaN or infinite, each an integer that a long holds."""
    inside = lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float(1 << 63), F.lit(False))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, inside), F.lit(False))


def integers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of usable vectors, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(x * scale).astype(np.int64).reshape(-1, dims)


def encode(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integers that occur, dimension after dimension, where each begins, and codes."""
    found = [np.unique(column, return_inverse=True) for column in q.T]
    starts = np.cumsum([0, *(len(values) for values, _ in found)])
    return np.concatenate([v for v, _ in found]), starts, np.stack([c for _, c in found], axis=1).astype("<u2")


def _wide(values: np.ndarray, centroids: list[list[int]], dims: int) -> bool:
    """May a sum of squares leave 64 bits?  Then Python's integers count."""
    most = max(abs(int(values.min())), abs(int(values.max())), *(abs(x) for c in centroids for x in c))
    return dims * (2 * most) ** 2 > LARGEST or most * BLOCK > LARGEST


def assign(
    values: np.ndarray, starts: np.ndarray, codes: np.ndarray, centroids: list[list[int]]
) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the smaller number of several, and its squared distance."""
    kind = object if _wide(values, centroids, codes.shape[1]) else np.int64
    values, centres = values.astype(kind), np.array(centroids, dtype=kind)
    total = np.zeros((len(codes), len(centroids)), kind)
    for d in range(codes.shape[1]):
        table = (values[starts[d] : starts[d + 1], None] - centres[None, :, d]) ** 2
        total += table[codes[:, d]]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(codes)), cluster]


def blocks(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """The vectors as stored blocks of integers that occur, and codes for them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = integers(batch.column(0), dims, scale)
            for i in range(0, len(q), BLOCK):
                values, starts, codes = encode(q[i : i + BLOCK])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([values], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([codes.tobytes()])],
                    names=["values", "starts", "codes"],
                )

    return store(vectors.mapInArrow(cut, "values array<long>, starts array<long>, codes binary"), "clustering")


def sums(stored: DataFrame, centroids: list[list[int]], dims: int) -> tuple[list[list[int]], list[int], list[int]]:
    """Per cluster the exact sum of its vectors, their number and their distances' sum.

    A task adds up its blocks and sends one number per cluster and dimension;
    Spark adds these, so the driver gets ``k * (dims + 2)`` numbers.
    """
    k = len(centroids)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims + 2) for _ in range(k)]
        for batch in batches:
            for row in range(batch.num_rows):
                values = batch.column(0)[row].values.to_numpy()
                starts = batch.column(1)[row].values.to_numpy()
                codes = np.frombuffer(batch.column(2)[row].as_py(), "<u2").reshape(-1, dims)
                cluster, distance = assign(values, starts, codes, centroids)
                exact = values.astype(distance.dtype)
                for c in np.unique(cluster):
                    mine = cluster == c
                    part = exact[codes[mine] + starts[:-1]].sum(axis=0)
                    for d in range(dims):
                        total[c][d] += int(part[d])
                    total[c][dims] += int(mine.sum())
                    total[c][dims + 1] += sum(distance[mine].tolist())
        found = [(c, d, Decimal(x)) for c in range(k) if total[c][dims] for d, x in enumerate(total[c])]
        c, d, x = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(x, pa.decimal128(38, 0))], names=["cluster", "place", "part"]
        )

    parts = stored.mapInArrow(tally, "cluster int, place int, part decimal(38,0)")
    whole = [[0] * (dims + 2) for _ in range(k)]
    for row in parts.groupBy("cluster", "place").agg(F.sum("part").alias("whole")).collect():
        whole[row["cluster"]][row["place"]] = int(row["whole"])
    return [w[:dims] for w in whole], [w[dims] for w in whole], [w[dims + 1] for w in whole]


def fit(
    df: DataFrame, key: str, vector: str, k: int, rounds: int, dims: int, scale: float, seed: str
) -> tuple[list[list[int]], list[int]] | None:
    """The centroids after all rounds, and the distances' sum per cluster; ``None`` without vectors."""
    rows = df.select(quoted(key).alias("key"), quoted(vector).alias("vector")).where(usable(F.col("vector"), dims, scale))
    stored = blocks(rows.select("vector"), dims, scale)
    mark = F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256)
    first = rows.withColumn("mark", mark).orderBy(F.col("mark").asc_nulls_last(), "vector").limit(k).toArrow()
    if not first.num_rows:
        return None
    centroids = integers(first.column("vector").combine_chunks(), dims, scale).tolist()
    for _ in range(rounds):
        added, number, _ = sums(stored, centroids, dims)
        centroids = [[x // n for x in s] if n else c for s, n, c in zip(added, number, centroids)]
    return centroids, sums(stored, centroids, dims)[2]


def clustered(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: float = 1024.0,
    seed: str = "3:",
) -> DataFrame:
    """Each usable vector's ``row``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Component x counts as the integer ``floor(scale * x)``.  The first centroids
    are the ``k`` vectors whose ``sha256(seed || key)`` is smallest, in this
    order; a round gives every vector to the nearest centroid (of several the
    smaller number) and moves each centroid that has vectors to the
    componentwise floor of their mean.

    Rows whose vector is null, has not ``dims`` components, or holds a null, a
    number that is not finite or one whose integer no long can hold are not
    returned; an empty table gives no rows.  With fewer than ``k`` vectors
    there are as many centroids as vectors.  A null key can start a cluster
    only where no other is left; rows with the same key are ordered by their
    vectors, and equal rows are vectors of their own.  Distances and their sums
    beyond a long are shown as the largest long; they are compared exactly.
    """
    if df.schema[vector].dataType.simpleString() not in ("array<float>", "array<double>"):
        df = df.withColumn(vector, quoted(vector).cast("array<double>"))
    rows = packed(df)
    at = df.columns.index(vector)
    added = StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    schema = StructType([StructField("row", rows.schema["row"].dataType, False), *added])
    model = fit(df, key, vector, k, rounds, dims, scale, seed)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    centroids, inertia = model
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    shown = lambda x: min(int(x), LARGEST)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            q = integers(row.field(at), dims, scale)
            for i in range(0, len(q), BLOCK):
                cluster, distance = assign(*encode(q[i : i + BLOCK]), centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        row.slice(i, BLOCK),
                        pa.array(cluster.astype(np.int32)),
                        pa.array([shown(x) for x in distance], pa.int64()),
                        pa.array([shown(inertia[c]) for c in cluster], pa.int64()),
                        pa.array([shown(sum(inertia))] * len(cluster), pa.int64()),
                        pa.array([marks[c] for c in cluster]),
                    ],
                    names=["row", *added.names],
                )

    return rows.where(usable(F.col("row")[vector], dims, scale)).mapInArrow(place, schema)
