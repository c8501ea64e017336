"""Row shaping: keys, remaining work, batches, splits, slices, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom import constants as K
from sentiloom.functions import text as X
from sentiloom.functions.arrays import aspect_mask, attention, pad
from sentiloom.operators.scale import dense_index, fits_broadcast, frequency_join, stored

# Names of the training bundle and the columns they come from.
BUNDLE_COLUMNS = {
    "raw_texts": "raw_text",
    "raw_aspect_terms": "aspect",
    "bert_tokens": "token_ids",
    "aspect_masks": "aspect_mask",
    "implicits": "implicitness",
    "labels": "polarity",
}


def to_training(df: DataFrame) -> DataFrame:
    """The six training columns under their bundle names."""
    return df.select(*[F.col(src).alias(dst) for dst, src in BUNDLE_COLUMNS.items()])


def row_key(cols: list[str]) -> Column:
    """Hash of the row's own values: the same in every run and partitioning.

    Lengths are hashed with the values, so neighbours cannot run together.
    """
    parts = []
    for c in cols:
        value = F.col(f"`{c}`").cast("string")
        parts.append(
            F.when(value.isNull(), "-").otherwise(
                F.concat(F.length(value).cast("string"), F.lit(":"), value)
            )
        )
    return F.sha2(F.concat(*parts), 256)


def with_row_key(df: DataFrame, cols: list[str], name: str = "row_key") -> DataFrame:
    return df.withColumn(name, row_key(cols))


def parse_comment_time(value: Column | str) -> Column:
    """Export time to timestamp; NULL when it cannot be read."""
    return F.try_to_timestamp(X.col(value), F.lit(K.EXPORT_TIME))


def stored_time(value: Column | str) -> Column:
    return F.date_format(X.col(value), K.STORED_TIME)


def remaining(base: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet.  Rows without a key never qualify."""
    return base.where(F.col(key).isNotNull()).join(
        processed_keys(done, key), key, "left_anti"
    )


def without_key(base: DataFrame, key: str) -> DataFrame:
    """The quarantine of :func:`remaining`: rows that have no key."""
    return base.where(F.col(key).isNull()).withColumn("reject_reason", F.lit("no key"))


def processed_keys(done: DataFrame, key: str) -> DataFrame:
    return done.select(key).where(F.col(key).isNotNull()).distinct()


def progress(base: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: rows in all, half of them, done, remaining, without key."""
    keyed = base.where(F.col(key).isNotNull()).select(key)
    flags = keyed.join(
        processed_keys(done, key).withColumn("_done", F.lit(1)), key, "left"
    ).select(F.coalesce("_done", F.lit(0)).alias("done"), F.lit(0).alias("nokey"))
    blank = base.where(F.col(key).isNull()).select(
        F.lit(0).alias("done"), F.lit(1).alias("nokey")
    )
    return (
        flags.unionByName(blank)
        .agg(
            F.count("*").alias("total"),
            F.coalesce(F.sum("done"), F.lit(0)).alias("done"),
            F.coalesce(F.sum("nokey"), F.lit(0)).alias("without_key"),
        )
        .select(
            "total",
            F.floor(F.col("total") / 2).alias("half"),
            "done",
            (F.col("total") - F.col("done") - F.col("without_key")).alias("remaining"),
            "without_key",
        )
    )


def batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Dense batch number and position in the batch, every batch full but the last."""
    return (
        dense_index(df, order, "_idx", wide=True)
        .withColumn("batch_id", F.floor(F.col("_idx") / size))
        .withColumn("pos", F.pmod(F.col("_idx"), F.lit(size)))
        .drop("_idx")
    )


def batch_count(df: DataFrame, size: int = K.EVALUATION_BATCH) -> DataFrame:
    """How many batches an evaluation takes."""
    return df.agg(
        F.count("*").alias("n_rows"), F.ceil(F.count("*") / size).alias("n_batches")
    )


def split_last_n(
    df: DataFrame, order: list[str], n: int = K.VALIDATION_ROWS, name: str = "split"
) -> DataFrame:
    """Last ``n`` rows of an order are 'valid', the others 'train'.

    Rows alike in ``order`` are told apart by a hash of all they hold; only
    rows alike in everything share their side.  The n-th last key is found as
    a top-n, then the split is one comparison.
    """
    key = F.struct(*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_tie"))
    cut = df.select(key.alias("_key")).orderBy(F.col("_key").desc()).limit(n).agg(F.min("_key")).scalar()
    return df.withColumn(name, F.when(key >= cut, "valid").otherwise("train"))


def eval_slices(df: DataFrame, implicit: str = "implicit") -> DataFrame:
    """Every row under 'total' and under 'implicits' or 'explicits'."""
    kind = F.when(F.col(implicit).cast("int") == 1, "implicits").when(
        F.col(implicit).cast("int") == 0, "explicits"
    )
    return df.withColumn(
        "slice", F.explode(F.array_compact(F.array(F.lit("total"), kind)))
    )


def collect_texts(
    df: DataFrame, text: str, order: str, per_array: int = 1000
) -> DataFrame:
    """A text column as ordered arrays of at most ``per_array`` values."""
    numbered = dense_index(df.select(order, text), [order], "_idx", wide=True)
    return (
        numbered.groupBy(F.floor(F.col("_idx") / per_array).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("_idx", text))).alias("_rows"))
        .select("chunk", F.col("_rows").getField(text).alias("texts"))
    )


def _field(rows: str, holder: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[holder][name])


def rows_to_bundle(
    df: DataFrame, order: list[str], columns: list[str], per_bundle: int = 1000
) -> DataFrame:
    """Columns as parallel lists, one row per ``per_bundle`` rows.

    Each value sits in a struct, so that a NULL keeps its place in its list.
    """
    numbered = dense_index(
        df.select(*dict.fromkeys([*order, *columns])), order, "_idx", wide=True
    )
    rows = F.array_sort(
        F.collect_list(F.struct("_idx", *[F.struct(c).alias(c) for c in columns]))
    )
    return (
        numbered.groupBy(F.floor(F.col("_idx") / per_bundle).alias("shard"))
        .agg(rows.alias("_rows"))
        .select(
            "shard",
            *[_field("_rows", c, c).alias(c) for c in columns],
        )
    )


def bundle_to_rows(df: DataFrame, shard: str | None = None) -> DataFrame:
    """Parallel lists back to rows ``(shard, pos, text, target, label, implicit)``.

    A bundle without ``implicits`` gives 0.  Lists of unequal length give rows
    with ``aligned`` false instead of moving values to a neighbour's row.
    """
    has_flags = "implicits" in df.columns
    lists = ["raw_texts", "raw_aspect_terms", "labels"] + ["implicits"] * has_flags
    sizes = [F.array_size(c) for c in lists]
    aligned = F.greatest(*sizes) == F.least(*sizes)
    keep = [shard] if shard else []
    rows = df.select(
        *keep, aligned.alias("aligned"), F.posexplode(F.arrays_zip(*lists)).alias("pos", "r")
    )
    implicit = F.col("r.implicits").cast("int") if has_flags else F.lit(0)
    return rows.select(
        *keep,
        "pos",
        F.col("r.raw_texts").alias("text"),
        F.col("r.raw_aspect_terms").alias("target"),
        F.col("r.labels").alias("label"),
        implicit.alias("implicit"),
        "aligned",
    )


def explode_aspects(df: DataFrame, aspects: str = "aspects", outer: bool = False) -> DataFrame:
    """One row per aspect with its position; without aspects no row, unless outer."""
    split = F.posexplode_outer if outer else F.posexplode
    keep = [c for c in df.columns if c != aspects]
    return df.select(*keep, split(aspects).alias("aspect_pos", "aspect"))


def explode_nested(df: DataFrame, nests: str) -> DataFrame:
    """One row per inner integer list."""
    keep = [c for c in df.columns if c != nests]
    return df.select(*keep, F.explode(nests).alias(nests))


def with_aspect_mask(
    df: DataFrame, ids: str = "token_ids", aspect_ids: str = "aspect_ids"
) -> DataFrame:
    """Mask of every row against that row's own tokens."""
    return df.withColumn("aspect_mask", aspect_mask(ids, aspect_ids))


def pad_batch(
    df: DataFrame, ids: str = "token_ids", batch: str = "batch_id", pad_id: int = 0
) -> DataFrame:
    """Pad to the longest row of the batch; add type ids and attention mask.

    The longest length is aggregated and joined back: batches may be uneven.
    """
    longest = df.groupBy(batch).agg(F.max(F.array_size(ids)).alias("_longest"))
    return df.join(longest, batch).select(
        *[c for c in df.columns if c != ids],
        pad(ids, F.col("_longest"), pad_id).alias("input_ids"),
        F.array_repeat(F.lit(0), F.col("_longest")).alias("token_type_ids"),
        attention(ids, F.col("_longest")).alias("attention_mask"),
    )


def attach_tokens(batch: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Token arrays of each row, by row key and never by text."""
    return batch.join(tokens, key, "left")


def attach_aspects(batch: DataFrame, aspects: DataFrame, key: str) -> DataFrame:
    """Aspect lists of each row, by row key."""
    return batch.join(aspects, key, "left")


def attach_labels(rows: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Label rows with the full comment record, comment columns first."""
    own = [c for c in rows.columns if c != key and c not in base.columns]
    return rows.select(key, *own).join(base, key, "left").select(*base.columns, *own)


def align_by_position(lists: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Parallel lists as rows, a missing partner is NULL and flagged.

    Works within the row, so no list is moved between tasks.
    """
    sizes = [F.coalesce(F.array_size(c), F.lit(0)) for c in columns]
    equal = F.greatest(*sizes) == F.least(*sizes)
    full = [F.coalesce(F.col(c), F.array().cast(lists.schema[c].dataType)).alias(c) for c in columns]
    rows = lists.select(
        *keys, equal.alias("aligned"), F.arrays_zip(*full).alias("_zip")
    ).select(*keys, "aligned", F.posexplode("_zip").alias("pos", "_row"))
    return rows.select(
        *keys, "pos", *[F.col(f"_row.`{c}`").alias(c) for c in columns], "aligned"
    )


def encode(tokens: DataFrame, vocab: DataFrame, key: str, unk_id: int) -> DataFrame:
    """Token rows ``(key, pos, word)`` to one id array per key, in token order.

    ``vocab`` is ``(word, id)``.  One that fits a broadcast needs no shuffle
    of tokens.  For any other, or with a column ``n`` in it, the tokens' own
    words are counted, with their ids or without: frequent words, known or
    not, are looked up where they are, and only rare ones move.  Position and
    id travel as one long, and the ids of a row are put together on the map
    side, so the shuffle carries one small array per row.
    """
    rows = tokens.select(key, "pos", "word")
    ids = vocab.select("word", "id")
    if "n" in vocab.columns or not fits_broadcast(ids):
        seen = rows.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
        found = frequency_join(rows, stored(seen.join(ids, "word", "left"), "token-counts"), ["word"])
    else:
        found = rows.join(F.broadcast(ids), ["word"], "left")
    packed = F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(
        F.coalesce("id", F.lit(unk_id)).cast("bigint")
    )
    low = F.lit((1 << 32) - 1)
    return (
        found.groupBy(key)
        .agg(F.sort_array(F.collect_list(packed)).alias("_p"))
        .select(
            key, F.transform("_p", lambda p: p.bitwiseAND(low).cast("int")).alias("token_ids")
        )
    )


def read_text_column(df: DataFrame, name: str = "Comment") -> DataFrame:
    """One column only, so a columnar scan reads nothing else."""
    return df.select(F.col(f"`{name}`"))


def order_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)
