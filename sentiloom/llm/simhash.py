"""SimHash near duplicates, found through one-wildcard variants of two halves.

Fingerprints that differ in at most three bits agree, but for one bit at
most, in one of their two 32-bit halves.  Each half is indexed 32 times, each
time with another bit left out; fingerprints that share such a signature are
candidates, and their whole fingerprints decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.llm.common import computed, quoted, store
from sentiloom.llm.components import components

SHINGLE = 3
DISTANCE = 3
#: Signatures with more fingerprints are compared block by block.
BLOCK = 8192
#: Hashes whose bits are added at a time.
HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that are set in over half the hashes of the text's word shingles.

    A-Z are lower-cased, words part at ASCII white space; fewer words than a
    shingle has are one shingle, no words at all give zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for i in range(0, n, HASHES):
        part = words[i : i + HASHES + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle)))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``row`` and ``fingerprint``, 64 bits in a long.  Null and empty texts have zero."""

    def compute(texts):
        found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return [found.view(np.int64)]

    return computed(df, [text], "fingerprint long", compute)


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def _pairs_within(keys: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple]:
    """Links of small groups, all groups at once: each row with the k-th after it."""
    k = 1
    while k < len(keys):
        same = keys[k:] == keys[:-k]
        if not same.any():
            return
        ok = same & _near(prints[k:], prints[:-k], distance)
        yield prints[:-k][ok], prints[k:][ok]
        k += 1


def _forest(prints: np.ndarray, distance: int) -> Iterator[tuple]:
    """Links that hold a large group's components together, in a walk that
    compares each fingerprint reached with those not reached yet."""
    left = prints
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            ok = _near(left, x, distance)
            found, left = left[ok], left[~ok]
            yield np.full(len(found), x), found
            front.extend(found)


def _links(batches: Iterator[pa.RecordBatch], distance: int, small: int = 24) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by signature; a group may go on in the next batch."""

    def links(keys, prints):
        _, first, size = np.unique(keys, return_index=True, return_counts=True)
        few = np.repeat(size <= small, size)
        yield from _pairs_within(keys[few], prints[few], distance)
        for i, n in zip(first[size > small], size[size > small]):
            yield from _forest(prints[i : i + n], distance)

    def out(keys, prints):
        pairs = [p for p in links(keys, prints) if len(p[0])]
        if not pairs:
            return
        a, b = (np.concatenate([p[i] for p in pairs]).view(np.int64) for i in (0, 1))
        ends = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
        cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        yield from out(keys[:cut], prints[:cut])
        keys, prints = keys[cut:], prints[cut:]
    yield from out(keys, prints)


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect all that are near.

    ``prints`` has one row per fingerprint.  Signatures of one fingerprint go
    after one shuffle.  A signature that very many share is cut into blocks,
    and pairs of blocks are compared, so that no task holds a whole group;
    from a large group only links that keep its components are returned.
    """
    if distance > 3:
        raise ValueError("halves with one wildcard find up to three differing bits")
    low, high = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fingerprint", 32)
    variants = [
        F.lit((half << 37) + (bit << 32)).bitwiseOR(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))))
        for half, part in enumerate((low, high))
        for bit in range(32)
    ]
    signed = prints.select(F.explode(F.array(*variants)).alias("signature"), "fingerprint")
    shared = signed.withColumn(
        "n", F.count("*").over(Window.partitionBy("signature"))
    ).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fingerprint"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    met = shared.select("signature", "fingerprint", own.alias("own"), other.alias("other")).select(
        F.xxhash64("signature", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"),
        "fingerprint",
    )
    dealt = met.repartition("meeting").sortWithinPartitions("meeting", "fingerprint")
    found = dealt.mapInArrow(lambda x: _links(x, distance), "a long, b long")
    return found.distinct()


def classes(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row per document.

    ``component_id`` is the smallest id reachable over links of near
    fingerprints.  Texts without words have fingerprint zero and are linked
    like any other; copies are linked through their common fingerprint;
    repeated rows give repeated results; a null id never is the smallest one
    (a class of null ids has a null component).
    """
    prints = store(
        fingerprints(df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), "text", shingle)
        .select("row.doc_id", "fingerprint"),
        "fingerprints",
    )
    return prints.join(_members(prints, distance), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def _members(prints: DataFrame, distance: int) -> DataFrame:
    """``(fingerprint, component, component_id)`` for every distinct fingerprint."""
    least = store(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    found = components(links(least.select("fingerprint"), distance), name="simhash")
    placed = least.join(found.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    whole = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(whole, "component").select("fingerprint", "component", "component_id")


def dedup(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """The rows of ``df``, one of each class: that of the smallest id.

    Among rows alike in their id the smallest fingerprint, then text hash,
    then place decides; a class whose ids are all null keeps one row as well.
    Texts are stored once beside a row number; classes are found on numbers
    and fingerprints, and one join by row number picks the texts.
    """
    printed = store(
        fingerprints(df, text, shingle).select(
            "row",
            "fingerprint",
            F.xxhash64(F.col("row").getField(text)).alias("hash"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "printed",
    )
    ids = printed.select(F.col("row").getField(doc_id).alias("doc_id"), "fingerprint", "hash", "place")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint", "hash", "place"))
    kept = (
        ids.groupBy("fingerprint").agg(first.alias("first"))
        .join(_members(ids, distance), "fingerprint")
        .groupBy("component").agg(F.min("first").alias("first"))
        .select("first.place")
    )
    return printed.join(kept, "place", "left_semi").select("row.*")
