"""Connected components of a link table, without a vertex that gathers all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import store


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Hang the neighbours of each vertex on the smallest of them.

    ``both`` looks at all neighbours and moves the greater ones (large star),
    else at the smaller neighbours only (small star).
    """
    if both:
        turned = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = turned.groupBy("a").agg(F.min("b").alias("least"))
        moved = turned.where("b > a").join(least, "a")
        return moved.select(
            F.col("b").alias("a"), F.least("a", "least").alias("b")
        ).distinct()
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``(id, component)`` for every id that has a link to another one.

    ``component`` is the smallest id reachable.  Large and small stars take
    turns until nothing moves (a number of rounds logarithmic in practice);
    each round's links, never more than vertices and links before, are stored
    in the shared folder.  Links with a null end or both ends alike are left
    out; repeated links count once.  A vertex with very many links is a
    partial minimum when grouped and a side that adaptive execution splits
    when joined.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = store(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sign = None
    while True:
        new_sign = tuple(
            now.agg(
                F.count("*"),
                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            ).first()
        )
        if new_sign == sign or not new_sign[0]:
            break
        sign = new_sign
        now = store(_star(_star(now, True), False), name)
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
