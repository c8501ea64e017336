"""Building blocks that keep joins and numbering safe on large, skewed data."""

from __future__ import annotations

from functools import reduce
from operator import add, or_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.session import ensure_checkpoint_dir

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HEAD_ROWS = 200_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from there.

    Whatever reads it more than once does not repeat the work above it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_labels(spark: SparkSession, blocks: int) -> list[int]:
    """A number for each block, so that Spark's hash puts each in a bucket of its own."""
    found, upto = {}, 8 * blocks
    while len(found) < blocks:
        numbers = spark.range(upto).select(F.col("id").cast("int").alias("i"))
        buckets = numbers.groupBy(F.pmod(F.hash("i"), F.lit(blocks)).alias("b")).agg(F.min("i").alias("i"))
        found = {r["b"]: r["i"] for r in buckets.collect()}  # one row a block
        upto *= 2
    return [found[b] for b in range(blocks)]


def fits_broadcast(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Measure a table, reading at most ``rows + 1`` rows of it."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` to a table with one row per key.

    A table measured as small is broadcast.  Any other is joined by a shuffle;
    a key that holds much of ``big`` makes a partition that adaptive execution
    splits by its bytes, as ``big`` is the side that may be split in inner,
    left, semi and anti joins.  Where most rows have few keys, and their counts
    are at hand, :func:`frequency_join` does not move these rows at all.
    """
    return big.join(F.broadcast(small) if fits_broadcast(small) else small, on, how)


def head_cut(
    counts: DataFrame, on: list[str], head_rows: int = HEAD_ROWS, head_bytes: int = BROADCAST_BYTES
) -> Column:
    """The count from which on keys are few and short enough to broadcast.

    Keys are tallied by the magnitude of their count (eight steps per power
    of two, so a few hundred steps in all).  From the top, whole steps are
    taken while rows and bytes stay within their bounds.
    """
    width = reduce(add, [F.coalesce(F.octet_length(c), F.lit(0)) for c in on])
    steps = counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 8).alias("step")).agg(
        F.min("n").alias("low"), F.count("*").alias("keys"), F.sum(width + 16).alias("bytes")
    )
    above = Window.orderBy(F.col("step").desc())
    fits = (F.sum("keys").over(above) <= head_rows) & (F.sum("bytes").over(above) <= head_bytes)
    return (
        steps.select("low", fits.alias("fits"))
        .agg(F.coalesce(F.min(F.when(F.col("fits"), F.col("low"))), F.lit((1 << 63) - 1)))
        .scalar()
    )


def frequency_join(
    rows: DataFrame, counts: DataFrame, on: list[str], head_rows: int = HEAD_ROWS, once: bool = True
) -> DataFrame:
    """Give every row the count ``n`` of its key, however skewed the keys are.

    ``counts`` holds the exact count of every key in ``rows``, and maybe other
    columns.  The most frequent keys, as many as :func:`head_cut` measures to
    be safe, are broadcast and their rows are never shuffled.  Any other key
    has about ``1 / head_rows`` of the rows at most, so the shuffled part has
    no hot key.  Keys seen once, the bulk of a vocabulary, need not travel
    when only the count is asked for: what finds none has 1.  No row is lost;
    a key that ``counts`` leaves out finds NULL in its other columns.  Without
    ``once``, rows whose key was seen once are left out.
    """
    cut = head_cut(counts, on, head_rows)
    is_head = F.col("n") >= cut
    known = rows.join(F.broadcast(counts.where(is_head)), on, "left")
    values = [c for c in counts.columns if c not in on]
    hot = known.where(F.col("n").isNotNull())
    rare = known.where(F.col("n").isNull()).drop(*values)
    if values == ["n"]:
        often = counts.where(~is_head & (F.col("n") > 1))
        found = rare.join(often, on, "left" if once else "inner").withColumn("n", F.coalesce("n", F.lit(1)))
    else:
        found = rare.join(counts.where(~is_head), on, "left")
    return hot.unionByName(found)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Split a scan that would leave half the cluster idle or more.

    A small file with one row group would otherwise be one task.  Rows are
    placed by ``key``, so later groupings by it need no further shuffle.  A
    large table has splits enough and is left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > slots:
        return df
    return df.repartition(slots, key)


def _is_key(df: DataFrame, columns: list[str]) -> bool:
    """Are these columns free of NULL and different in every row?"""
    missing = reduce(or_, [F.col(c).isNull() for c in columns])
    return (
        df.groupBy(*columns).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | missing).isEmpty()
    )


def dense_index(df: DataFrame, order: list[str], name: str = "idx", wide: bool = False) -> DataFrame:
    """Number rows 0, 1, 2, … in a total order without a one-task window.

    Rows are range partitioned and sorted, then stored once through a reliable
    checkpoint, so that both passes below see the same partitions.  The first
    pass counts each partition, the second adds the running sum of these
    counts (one row per partition) to the position within the partition.

    ``wide`` is for rows with texts or arrays: only the order columns are
    sorted and stored, and the rows get their number by a join.  It is used
    when the order columns turn out to be a key, and needs ``df`` to give the
    same rows each time it is read.
    """
    if wide and set(order) != set(df.columns) and _is_key(df, order):
        numbers = _numbered(df.select(*order), order, name)
        return df.join(numbers, order).select(*df.columns, name)
    return _numbered(df, order, name)


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn(
            "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
        .checkpoint()
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_part", "_at", "_offset")
    )
