"""Shards that balance bytes, tokens and rows by vector bin packing.

Groups of equal texts stay together.  Large groups are placed one by one,
small ones in bundles; each goes where the dot product of its needs with
what the shard has left is greatest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.llm.common import packed, quoted, store

#: Small groups meet in so many bundles for each shard; the packing then has
#: at most about five items for each bundle, whatever the corpus.
BUNDLES = 256
#: A group beyond this part of a shard is cut into pieces of that part.
LARGEST = 1 / 16
#: Counted in each size beside the bytes of the text.
ROW_BYTES = 16


def pack(needs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``needs`` has a row of bytes, tokens and rows for each.

    Items go largest first to the shard whose residual capacity has the
    greatest dot product with them, both as parts of the total; among equal
    shards to the first.
    """
    total = np.maximum(needs.sum(axis=0), 1)
    part = needs / total * shards
    left = np.ones((shards, needs.shape[1]))
    out = np.zeros(len(needs), np.int64)
    for i in np.argsort(-part.max(axis=1), kind="stable"):
        out[i] = k = int((left @ part[i]).argmax())
        left[k] -= part[i]
    return out


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``row``, its ``size``, ``tokens``, ``text_crc32`` and the ``same`` hash of its text.

    A null text has no bytes and no tokens and is like an empty one.
    """
    own = F.coalesce(F.col("row").getField(text), F.lit(""))
    return packed(df).select(
        "row",
        (F.octet_length(own) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.regexp_count(own, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(own.cast("binary")).alias("text_crc32"),
        F.sha2(own, 256).alias("same"),
    )


def shards(df: DataFrame, count: int = 40, text: str = "text", order: str = "doc_id", bundles: int = BUNDLES) -> DataFrame:
    """``row``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    Bytes (text and ``ROW_BYTES``), tokens and rows are balanced jointly.
    Equal texts share a shard, unless they are more than ``LARGEST`` of one:
    such groups are cut into pieces by row number.  Slots count from 0 in
    each shard without gaps, in the order of the items and then of ``order``.
    What decides on groups is a table of sums that has some five rows for each
    bundle at most, whatever the corpus; rows meet in parts of a shard only,
    to be numbered.  Null texts count as empty ones; repeated rows are rows of
    their own; an empty table gives no rows.
    """
    kept = store(measured(df, text).withColumn("place", F.monotonically_increasing_id()), "measured")
    placed = _placed(kept.withColumn("order", F.col("row").getField(order)), count, bundles)
    return placed.select("row", "size", "text_crc32", "shard", "slot")


def _placed(rows: DataFrame, count: int, bundles: int) -> DataFrame:
    needs = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*needs).first()
    most = [max((total[k] or 0) / count, 1) for k in ("bytes", "tokens", "n")]
    part = F.greatest(*[F.col(k) / m for k, m in zip(("bytes", "tokens", "n"), most)])
    large = (
        rows.groupBy("same").agg(*needs).withColumn("part", part).where(F.col("part") > 1 / bundles)
        .select("same", F.ceil(F.col("part") / LARGEST).alias("pieces"))
    )
    own = F.pmod(F.xxhash64("place"), F.col("pieces"))
    bundle = F.pmod(F.xxhash64("same", F.lit(1)), F.lit(count * bundles))
    # at most 3 * count * bundles groups are large, as each has 1 / bundles of a shard in one of three sums
    item = F.when(F.col("pieces").isNotNull(), F.concat_ws(":", "same", own)).otherwise(F.concat(F.lit("bundle:"), bundle))
    dealt = rows.join(F.broadcast(large), "same", "left").withColumn("item", item)
    sums = dealt.groupBy("item").agg(*needs).orderBy("item").toArrow()
    names = sums.column("item").to_pylist()
    needed = np.stack([sums.column(k).to_numpy().astype(np.float64) for k in ("bytes", "tokens", "n")], axis=1)
    shard = pack(needed, count)
    first, before = np.zeros(count, np.int64), []
    for k, n in zip(shard, needed[:, 2].astype(np.int64)):
        before.append(int(first[k]))
        first[k] += n
    spark = rows.sparkSession
    where = spark.createDataFrame(
        list(zip(names, (int(k) for k in shard), before)), "item string, shard int, before long"
    )
    at = F.row_number().over(Window.partitionBy("item").orderBy("order", "place")) - 1
    numbered = dealt.join(F.broadcast(where), "item")
    return numbered.withColumn("slot", (F.col("before") + at).cast("long"))
