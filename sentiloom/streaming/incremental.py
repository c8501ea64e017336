"""Incremental labelling: only what is new, and a replay repeats nothing.

Which keys were seen is the state of a streaming query, kept by RocksDB and
partitioned by key.  A batch reads its own rows and looks up its own keys, which
alone go through the state; what the sink holds is never read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom.sources.comments import CSV_OPTIONS, _with_corrupt, prepare_comments

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; it need not fit in memory."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def owned_keys(spark: SparkSession, path: str, batch_id: int, of: T.DataType) -> DataFrame:
    """``(key)``: the keys that this batch was the first to claim."""
    schema = T.StructType([T.StructField("key", of), T.StructField("step", T.LongType()), T.StructField("batch_id", T.LongType())])
    return _read(spark, f"{path}/owned", schema).where(F.col("batch_id") == batch_id).select("key")


def claim(keys: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Which keys of a one-column table does no earlier batch have?  ``(key)``, each once.

    The keys are laid down below ``keys``, and a query that resumes from
    ``state`` drops those it has met before; what is left is the batch's own,
    also when the batch is run again after a failure at any point.  A key laid
    down is not laid down again.  Where a failure leaves several batches to be
    taken up together, a key that they share goes to one of them.  Keys are
    remembered for ever, some tens of bytes each on the executors' disks and in
    the checkpoint; a null key is nobody's.
    """
    spark, of = keys.sparkSession, keys.schema[0].dataType
    schema = T.StructType([T.StructField("key", of), T.StructField("batch_id", T.LongType())])
    laid = _read(spark, f"{path}/keys", schema).where(F.col("batch_id") == batch_id).select("key")
    new = keys.toDF("key").where("key IS NOT NULL").distinct().join(laid, "key", "left_anti")
    new.write.mode("append").parquet(f"{path}/keys/batch_id={batch_id}")

    def keep(batch: DataFrame, step: int) -> None:
        batch.write.mode("overwrite").partitionBy("batch_id").parquet(f"{path}/owned/step={step}")

    with _rocksdb(spark):
        fresh = spark.readStream.schema(schema).parquet(f"{path}/keys").dropDuplicates(["key"])
        _run(fresh, f"{path}/state", keep)
    return owned_keys(spark, path, batch_id, of)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def first_copies(df: DataFrame, key: str, time: str = "comment_time") -> DataFrame:
    """One row per key, the earliest, and ``_copies``: how many there are.

    Among rows of one time the smallest hash of all values decides, so that a
    replay keeps the same row.  A key with very many copies is a minimum that
    every task takes first.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    order = F.struct(F.col(time).isNull(), F.col(time), F.xxhash64(*columns))
    first = F.min_by(F.struct(*columns), order)
    return df.groupBy(F.col(key).alias("_key")).agg(first.alias("_row"), F.count("*").alias("_copies")).select("_row.*", "_copies")


def replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of a batch in place of whatever it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def idempotent_append(df: DataFrame, path: str, key: str, batch_id: int) -> None:
    """Add rows whose key no other batch has stored, as the files of this batch.

    A batch owns the directory ``batch_id=…`` and replaces it, and it owns the
    keys that it was first to :func:`claim` in ``_keys``, so a batch that is run
    again leaves the same rows, not twice as many.  Rows without a key are left
    out.  Only what came through here is known: a sink written otherwise has no
    keys.
    """
    own = claim(df.select(key), f"{path}/_keys", batch_id)
    replace_batch(df.join(own.withColumnRenamed("key", key), key, "left_semi"), path, batch_id)


def _run(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def stream_label(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    schema: T.StructType,
    label: Callable[[DataFrame], DataFrame],
    quarantine: str | None = None,
    key: str = "comment_key",
) -> None:
    """Label every comment file that has not been read before, then stop.

    The stream's checkpoint remembers the files and the keys, which also covers
    a comment that is exported again in a later file.  ``label`` turns prepared
    comments into rows that still carry ``key``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = prepare_comments(batch)
        counted = first_copies(rows.where(F.col("reject_reason").isNull()), key)
        # asked before the model is: neither stored comments nor a second copy
        own = claim(rows.where(F.col("reject_reason").isNull()).select(key), f"{checkpoint}/claimed", batch_id)
        once = counted.drop("_copies", "reject_reason", "_corrupt_record")
        replace_batch(label(once.join(own.withColumnRenamed("key", key), key, "left_semi")), sink, batch_id)
        if quarantine:
            more = F.concat(F.lit("repeated "), F.col("_copies") - 1)
            repeated = counted.where("_copies > 1").withColumn("reject_reason", more).drop("_copies")
            refused = rows.where(F.col("reject_reason").isNotNull()).unionByName(repeated)
            replace_batch(refused, quarantine, batch_id)

    _run(spark.readStream.schema(_with_corrupt(schema)).options(**CSV_OPTIONS).csv(source), checkpoint, run)
