"""Comment exports in CSV, and the XML form of annotated sentences."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sentiloom import schemas
from sentiloom.operators.scale import fits_broadcast, stored
from sentiloom.operators.shape import parse_comment_time

# Quotes are doubled inside quotes and a comment may span lines.
CSV_OPTIONS = {
    "header": "true",
    "enforceSchema": "false",  # every file's header is checked, not only the first
    "multiLine": "true",
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
}
GUARD = r'^="?|"$'


def clean_id(value) -> F.Column:
    """A spreadsheet-guarded id (``="735…"``) as plain text."""
    return F.regexp_replace(value, GUARD, "")


def comment_schema(columns: list[str], file: str = "") -> T.StructType:
    """The known schema with this header; unknown headers are refused."""
    header = [c.lstrip("\ufeff") for c in columns]
    for known in (schemas.COMMENTS, schemas.COMMENTS_SHORT):
        if header == known.fieldNames():
            return known
    raise ValueError(f"unknown comment header: {header} {file}".rstrip())


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def inside_after(line: str, inside: bool) -> bool:
    """Does a quoted field go on after this line?  ``inside`` says whether one did before.

    A quote opens a field only at its start, a doubled one is text, and what
    follows the end of a quoted field up to the delimiter belongs to it.
    """
    line, at = line.removesuffix("\r"), 0
    while True:
        if not inside:
            if line[at : at + 1] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(",", at) + 1
                if not at or line.find('"', at) < 0:
                    return False
                continue
        close = line.find('"', at)
        while close >= 0 and line[close + 1 : close + 2] == '"':
            close = line.find('"', close + 2)
        if close < 0:
            return True
        inside, at = False, line.find(",", close + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of their split; ``block`` is where the split begins in its file."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _split_states(lines: DataFrame) -> DataFrame:
    """``(file, block, from_out, from_in, header)`` per split of a file.

    ``from_out`` and ``from_in`` say whether its last line ends inside a quoted
    field if its first one begins outside or inside; a split at a file's start
    knows the header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, None
        for batch in batches:
            done = []
            for file, block, line in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, block) != key:
                    done += [row] if row else []
                    key, row = (file, block), [file, block, False, True, line if block == 0 else None]
                if '"' in line:
                    row[2:4] = [inside_after(line, row[2]), inside_after(line, row[3])]
            yield _batch(done, SPLIT)
        yield _batch([row] if row else [], SPLIT)

    return lines.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean, header string")


SPLIT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_()), ("header", pa.string())])
RECORD = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("record", pa.string())])
WHOLE, CONTINUED, OPEN = 0, 1, 2


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _header_kind(header: F.Column) -> F.Column:
    """1 for the long header, 0 for the short one, else NULL."""
    named = F.transform(F.split(F.regexp_replace(header, r'^\ufeff|\r$', ""), ","), lambda c: F.regexp_replace(c, r'^\ufeff?"|"$', ""))
    known = [(1, schemas.COMMENTS), (0, schemas.COMMENTS_SHORT)]
    return F.coalesce(*[F.when(named == F.array(*[F.lit(c) for c in s.fieldNames()]), F.lit(k)) for k, s in known])


def _resolved(splits: DataFrame) -> DataFrame:
    """``(file, block, inside, open, kind, header, crlf)``: how each split really begins and ends.

    A split either keeps, swaps or fixes the state, so the last one before that
    fixes it and the number of swaps since decide.  The window has a row per
    split of a file.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixes, swaps = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    counted = splits.withColumn("swaps", F.sum(swaps.cast("int")).over(order))
    fixed = F.last(F.when(fixes, F.struct("from_out", "swaps")), ignorenulls=True).over(before)
    since = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(fixed["swaps"], F.lit(0))
    inside = F.coalesce(fixed["from_out"], F.lit(False)) != (since % 2 == 1)
    begun = counted.withColumn("inside", inside)
    return begun.select(
        "file",
        "block",
        "inside",
        F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("open"),
        F.first(_header_kind(F.col("header"))).over(order).alias("kind"),
        F.first("header").over(order).alias("header"),
    ).withColumn("crlf", F.endswith("header", F.lit("\r")))


def _records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """``(file, block, kind, part, record)``: records, and what splits hold of others."""
    known = states.select("file", "block", "inside", "kind", "crlf")
    if fits_broadcast(known):  # lines stay in their order
        placed = lines.join(F.broadcast(known), ["file", "block"])
    else:
        numbered = lines.withColumn("place", F.monotonically_increasing_id())
        placed = numbered.join(known, ["file", "block"]).sortWithinPartitions("file", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, begun, part = None, False, [], WHOLE
        for batch in batches:
            done = []
            for file, block, line, starts, kind, crlf in zip(*[c.to_pylist() for c in batch.columns]):
                if key is None or key[:2] != (file, block):
                    if begun:
                        done.append((*key, CONTINUED if part == CONTINUED else OPEN, "\n".join(begun)))
                    key, inside, begun, part = (file, block, kind), starts, [], CONTINUED if starts else WHOLE
                    if block == 0:
                        continue  # the header
                begun.append(line.removesuffix("\r") if crlf else line)
                inside = inside_after(line, inside) if '"' in line else inside
                if not inside:
                    record = "\n".join(begun).removesuffix("\r")
                    if record or part == CONTINUED:  # empty lines are no records
                        done.append((*key, part, record))
                    begun, part = [], WHOLE
            yield _batch(done, RECORD)
        if begun:
            yield _batch([(*key, CONTINUED if part == CONTINUED else OPEN, "\n".join(begun))], RECORD)

    columns = placed.select("file", "block", "value", "inside", "kind", "crlf")
    return columns.mapInArrow(run, "file string, block long, kind int, part int, record string")


def _joined(parts: DataFrame) -> DataFrame:
    """Records that cross splits: what one split leaves open, and what follows it."""
    number = F.sum((F.col("part") == OPEN).cast("int")).over(Window.partitionBy("file").orderBy("block", "part"))
    pieces = parts.where(f"part <> {WHOLE}").withColumn("number", number)
    whole = pieces.groupBy("file", "number", "kind").agg(F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("pieces"))
    return whole.select("kind", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comment rows as exported, plus a clean id, a timestamp and a verdict.

    The schema of a file follows its own header, so a folder may mix exports;
    columns a file has not are NULL, an unknown header is refused with the
    file's name.  Comments may span lines, and a large file is still read by
    many tasks: a first pass finds, for every split, whether it ends inside a
    quoted field if it begins outside or inside; running these through gives
    each split its start, and a second pass cuts records.  Only what crosses
    splits is shuffled, and only where there is any a third pass fetches it.
    Records end with a line feed, with or without a carriage return; where the
    header's line has one, those inside comments are line feeds as well.
    """
    lines = _lines(spark, path)
    states = stored(_resolved(_split_states(lines)), "splits")
    unknown = states.where("kind IS NULL").select("file", "header").first()
    if unknown:
        comment_schema(next(csv.reader([unknown["header"] or ""])), unquote(unknown["file"]))
        raise ValueError(f"unknown comment header: {unknown['header']} {unquote(unknown['file'])}")
    seen = states.agg(F.max("kind").alias("kind"), F.bool_or("open").alias("open")).first()
    parts = _records(lines, states)
    records = parts.where(f"part = {WHOLE}").select("kind", "record")
    if seen["open"]:
        records = records.union(_joined(parts))
    options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "enforceSchema")}
    parsed = [F.from_csv("record", _with_corrupt(s).toDDL(), options) for s in (schemas.COMMENTS_SHORT, schemas.COMMENTS)]
    rows = records.select("kind", F.when(F.col("kind") == 0, parsed[0]).alias("short"), F.when(F.col("kind") == 1, parsed[1]).alias("long"))
    names = (schemas.COMMENTS_SHORT if seen["kind"] == 0 else schemas.COMMENTS).fieldNames()
    short = {*schemas.COMMENTS_SHORT.fieldNames(), "_corrupt_record"}
    value = lambda c: F.coalesce(F.col("long")[c], F.col("short")[c]) if c in short else F.col("long")[c]
    return prepare_comments(rows.select(*[value(c).alias(c) for c in [*names, "_corrupt_record"]]))


def prepare_comments(raw: DataFrame) -> DataFrame:
    """Add ``comment_key``, ``comment_time`` and ``reject_reason`` (NULL is good)."""
    has_time = "Comment Time" in raw.columns
    time = parse_comment_time("Comment Time") if has_time else F.lit(None).cast("timestamp")
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in raw.columns else F.lit(False)
    bad_time = (
        F.col("Comment Time").isNotNull() & F.col("comment_time").isNull()
        if has_time
        else F.lit(False)
    )
    return (
        raw.withColumn("comment_key", clean_id(F.col("Comment ID")))
        .withColumn("comment_time", time)
        .withColumn(
            "reject_reason",
            F.when(corrupt, "corrupt record")
            .when(F.col("comment_key").isNull(), "no key")
            .when(F.col("Comment").isNull(), "no text")
            .when(bad_time, "bad time"),
        )
    )


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows without the verdict column, and the refused rows with it."""
    ok = F.col("reject_reason").isNull()
    return df.where(ok).drop("reject_reason", "_corrupt_record"), df.where(~ok)


def read_aspect_xml(spark: SparkSession, path: str) -> DataFrame:
    """Annotated sentences, one row per aspect term; none leaves one NULL row.

    ``reject_reason`` is NULL for usable rows.  A record that is not well formed
    is one row with its source in ``_corrupt_record``, and those behind it in its
    file are read all the same; a sentence without text is refused as well.
    :func:`split_quarantine` tells them apart.
    """
    corrupt = F.col("_corrupt_record").isNotNull()
    rows = (
        spark.read.format("xml")
        .option("rowTag", "sentence")
        .option("useLegacyXMLParser", "true")  # the other parser gives up a file at its first broken record
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(T.StructType([*schemas.ASPECT_XML.fields, T.StructField("_corrupt_record", T.StringType())]))
        .load(path)
    )
    reason = F.when(corrupt, "corrupt record").when(F.col("text").isNull(), "no text")
    return rows.select(
        F.col("_id").alias("sentence_id"),
        "text",
        F.posexplode_outer("aspectTerms.aspectTerm").alias("aspect_pos", "t"),
        "_corrupt_record",
        reason.alias("reject_reason"),
    ).select(
        "sentence_id",
        "text",
        "aspect_pos",
        F.col("t._term").alias("aspect"),
        F.col("t._polarity").alias("polarity"),
        F.col("t._from").alias("from"),
        F.col("t._to").alias("to"),
        (F.lower("t._implicit_sentiment") == "true").alias("implicitness"),
        F.col("t._opinion_words").alias("opinion_words"),
        "_corrupt_record",
        "reject_reason",
    )


def write_aspect_xml(rows: DataFrame, path: str) -> None:
    """Sentences in the form that :func:`read_aspect_xml` reads, appended.

    ``rows`` have ``sentence_id``, ``text`` and ``terms``, an array of structs
    with the fields of an aspect term.  Characters that XML cannot hold become
    U+FFFD; a reader drops white space around a text.
    """
    held = lambda c: F.regexp_replace(c, r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "\uFFFD")
    term = lambda t: F.struct(
        held(t["aspect"]).alias("_term"),
        t["polarity"].alias("_polarity"),
        t["from"].cast("int").alias("_from"),
        t["to"].cast("int").alias("_to"),
        F.when(t["implicitness"], "True").when(~t["implicitness"], "False").alias("_implicit_sentiment"),
        held(t["opinion_words"]).alias("_opinion_words"),
    )
    some = F.when(F.size("terms") > 0, F.struct(F.transform("terms", term).alias("aspectTerm")))
    rows.select(F.col("sentence_id").cast("string").alias("_id"), held("text").alias("text"), some.alias("aspectTerms")).write.mode(
        "append"
    ).format("xml").options(rootTag="sentences", rowTag="sentence").save(path)
