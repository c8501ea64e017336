"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target.  Its documents are taken a whole number of times,
and what is left of the target is a sample without replacement whose
inclusion probabilities follow the documents' sizes: documents that would
have a probability of one are taken for certain, the others are ranked by
random odds divided by inclusion odds, and the first of them are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.llm.common import packed, store

WEIGHTS = (3, 1, 2)
#: Ranks are counted in so many steps, and only the step at the edge is sorted.
STEPS = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Weights repeat over the sources by code point, null last.  No target
    exceeds ``most`` times its source; what is over goes to the others by
    weight until none exceeds.  In order of ``most * size / weight`` the
    sources that stop are the first ones, so running sums find them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    upto, every = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    listed = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.get(listed, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("long")
    )
    level = weighed.select(
        "source",
        "source_size",
        "weight",
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(upto), F.lit(0)).alias("weight_before"),
    )
    # a source stops if the rest of the total, by weight, would give it more than its most
    each = (F.col("total") - most * F.col("size_before")) / (F.col("weights") - F.col("weight_before"))
    stops = each * F.col("weight") >= most * F.col("source_size")
    rest = level.withColumn("each", F.when(~stops, each))
    first = F.first("each", ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rest.withColumn("first", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("each").isNull(), F.col("source_size") * F.lit(float(most)))
        .otherwise(F.col("first") * F.col("weight"))
        .alias("target"),
    )


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1 that every run repeats: 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


SOURCE = ["name", "nameless"]  # a null source and an empty one differ


def _probabilities(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add to each source the ``largest`` size that is not certain, and the ``scale``.

    Inclusion probabilities are ``scale * size``, and the words they promise,
    with those of certain documents (``above``), are the ``rest`` of the target.
    """
    down = Window.partitionBy(*SOURCE).orderBy(F.desc("size"))
    above = F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1))
    square = F.col("n").cast("decimal(38,0)") * F.col("size") * F.col("size")
    below = F.sum(square).over(down.rowsBetween(0, Window.unboundedFollowing))
    edges = (
        rows.where("size > 0")
        .groupBy(*SOURCE, "size")
        .agg(F.count("*").alias("n"))
        .select(*SOURCE, "size", F.coalesce(above, F.lit(0)).alias("above"), below.cast("double").alias("squares"))
        .join(plan.select(*SOURCE, "rest"), SOURCE)
        .withColumn("scale", (F.col("rest") - F.col("above")) / F.col("squares"))
        .where("rest > above and scale * size < 1")
        .groupBy(*SOURCE)
        .agg(F.max(F.struct("size", "scale", "above")).alias("edge"))
    )
    return plan.join(edges, SOURCE, "left").select(
        *plan.columns, F.col("edge.size").alias("largest"), "edge.scale", (F.col("rest") - F.col("edge.above")).alias("wanted")
    )


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Add the ``rank`` of each row by random odds over inclusion odds, and its ``step``."""
    u = uniform(F.lit(seed), F.col("key"))
    p = F.col("scale") * F.col("size")
    rank = F.when(
        (F.col("size") > 0) & (F.col("size") <= F.col("largest")), (u / (1 - u)) / (p / (1 - p))
    )
    return (
        rows.join(plan, SOURCE)
        .withColumn("rank", rank)
        .withColumn("step", F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS))
    )


def _cuts(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Add to each source the last rank and key that its sample takes.

    Words are summed by step first.  Only in the step where the wanted words
    are reached rows are sorted; the last one is taken if that comes nearer.
    """
    ranked = _ranked(rows, plan, seed).where("rank IS NOT NULL")
    steps = Window.partitionBy(*SOURCE).orderBy("step")
    sums = ranked.groupBy(*SOURCE, "step", "wanted").agg(F.sum("size").alias("words"))
    edge = (
        sums.withColumn("through", F.sum("words").over(steps))
        .where("through > wanted")
        .groupBy(*SOURCE)
        .agg(F.min(F.struct("step", (F.col("through") - F.col("words")).alias("before"))).alias("edge"))
        .select(*SOURCE, F.col("edge.step").alias("edge"), "edge.before")
    )
    inside = Window.partitionBy(*SOURCE).orderBy("rank", F.col("key").isNull(), "key", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    last = (
        ranked.join(edge, SOURCE)
        .where("step = edge")
        .withColumn("middle", F.col("before") + upto - F.col("size") / 2)
        .where("middle <= wanted")
        .groupBy(*SOURCE)
        .agg(F.max(F.struct("rank", F.col("key").isNull().alias("keyless"), "key", "size")).alias("last"))
    )
    return plan.join(edge.drop("before"), SOURCE, "left").join(last, SOURCE, "left")


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 0,
) -> DataFrame:
    """``row``, ``size``, ``source_size``, ``target`` and ``copies`` of every row.

    A document's size is its number of words, zero if its text is null or
    empty (such a document is never taken more than its source's whole
    copies).  ``copies`` is how often the mix takes the whole document.  Rows
    alike in key, source and size get the same random number and share their
    fate; a null key is a key like any other, a null source a source of its
    own after all others.  An empty table gives no rows.  Runs agree.

    Sums by source, size and step decide; what they decide is a row for each
    source, and the rows meet it where they are.
    """
    own = lambda c: F.col("row").getField(c)
    rows = packed(df).select(
        "row",
        own(key).alias("key"),
        n_words(own(text)).alias("size"),
        F.coalesce(own(source).cast("string"), F.lit("")).alias("name"),
        own(source).isNull().alias("nameless"),
    )
    sized = store(rows.drop("row"), "sizes")
    sums = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    named = sums.select(F.when(~F.col("nameless"), F.col("name")).alias("source"), "source_size")
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = (
        targets(named, weights, share, most)
        .select(
            F.coalesce("source", F.lit("")).alias("name"),
            F.col("source").isNull().alias("nameless"),
            "source_size",
            "target",
            whole.alias("whole"),
        )
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = store(_probabilities(sized, store(plan, "targets")), "probabilities")
    plan = store(_cuts(sized, plan, seed), "cuts")
    here = F.struct("rank", F.col("key").isNull().alias("keyless"), "key", "size")
    sampled = F.when(F.col("largest").isNull() | (F.col("size") == 0), F.lit(False)).otherwise(
        (F.col("size") > F.col("largest"))
        | F.col("edge").isNull()
        | (F.col("step") < F.col("edge"))
        | ((F.col("step") == F.col("edge")) & F.coalesce(here <= F.col("last"), F.lit(False)))
    )
    copies = F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("int")
    return _ranked(rows, plan, seed).select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of the mix with their own columns, each as often as it is taken."""
    found = mix(df, **options).where("copies > 0")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
