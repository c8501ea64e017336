"""Parquet tables, bundles, traces and the CSV files people review."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiloom import schemas
from sentiloom.functions import responses as R
from sentiloom.operators.scale import dense_index, spread
from sentiloom.operators.shape import BUNDLE_COLUMNS, rows_to_bundle

RECORD_END = "\n\n\n"
# Quotes doubled, blanks at the ends of a text kept.
CSV_WRITE = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_documents(spark: SparkSession, path: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """A text table; a scan with few splits is spread over the cluster by key."""
    df = spark.read.parquet(path)
    return spread(df.select(*columns) if columns else df, key)


def read_labelled(
    spark: SparkSession, path: str, schema: T.StructType = schemas.FINAL, merge: bool = True
) -> DataFrame:
    """Declared columns by name; absent ones are NULL, a missing path is empty.

    Stored types may be wider (``array<bigint>``); they are cast on read.
    ``merge`` looks at every file's footer, so that a column only later files
    have is not lost; switch it off for a table written by one job.
    """
    try:
        stored = spark.read.option("mergeSchema", str(merge).lower()).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    have = {c.lower(): c for c in stored.columns}

    def pick(field: T.StructField) -> Column:
        name = have.get(field.name.lower())
        source = F.lit(None) if name is None else F.col(f"`{name}`")
        return source.cast(field.dataType).alias(field.name)

    return stored.select(*[pick(f) for f in schema.fields])


def append_labelled(df: DataFrame, path: str) -> None:
    """Create the table or add to it."""
    df.write.mode("append").parquet(path)


def write_bundle(
    df: DataFrame, path: str, order: list[str], per_bundle: int = 1000, fmt: str = "parquet"
) -> None:
    """Training bundle: six parallel lists per ``per_bundle`` rows."""
    data = df.select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        *[F.col(src).alias(dst) for dst, src in BUNDLE_COLUMNS.items()],
    )
    bundle = rows_to_bundle(
        data, [f"_o{i}" for i in range(len(order))], list(BUNDLE_COLUMNS), per_bundle
    )
    bundle.write.mode("overwrite").format(fmt).save(path)


def read_bundle(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    schema = T.StructType([T.StructField("shard", T.LongType()), *schemas.BUNDLE.fields])
    return spark.read.schema(schema).format(fmt).load(path)


def arrays_as_text(df: DataFrame) -> DataFrame:
    """CSV has no arrays: write them as JSON."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            (F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def write_review_csv(df: DataFrame, path: str, order: list[str], single_file: bool = False) -> None:
    """CSV with a sequential id, replacing what was there.

    The ids run through as many files as there are partitions, in order.
    ``single_file`` is for a table that one person opens: rows come sorted and
    one task writes them.
    """
    numbered = arrays_as_text(dense_index(df, order, "sequential_id", wide=True))
    out = numbered.orderBy("sequential_id")
    if single_file:  # numbers are joined before, in as many tasks as ever
        out = numbered.repartition(1).sortWithinPartitions("sequential_id")
    out.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_annotation(df: DataFrame, csv_path: str, parquet_path: str) -> None:
    """The same rows as Parquet and as CSV; the CSV is made from the Parquet.

    Lists of a comment repeat a lot, as JSON most of all: both are compressed,
    the CSV by gzip, which its readers open as it is.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(parquet_path)
    stored = df.sparkSession.read.parquet(parquet_path)
    arrays_as_text(stored).write.mode("overwrite").options(**CSV_WRITE, compression="gzip").csv(csv_path)


def cache_name(data: str, size: str, model: str) -> str:
    return f"{data}_{size}_{model}".replace("/", "-")


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write once, then always read what is stored."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_trace(records: DataFrame, path: str, column: str = "record") -> None:
    """Append reasoning records, three line feeds after each."""
    records.select(F.col(column).alias("value")).write.mode("append").option(
        "lineSep", RECORD_END
    ).text(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Reasoning records with their fields and a verdict (NULL is good)."""
    records = (
        spark.read.option("lineSep", RECORD_END)
        .text(path)
        .where(F.length(F.trim("value")) > 0)
        .withColumnRenamed("value", "record")
    )
    return records.select(
        "record",
        R.trace_fields("record").alias("_f"),
        R.trace_reject("record").alias("reject_reason"),
    ).select("record", "_f.*", "reject_reason")
