"""What the operators share: whole rows beside computed columns, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from sentiloom.session import ensure_checkpoint_dir


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one struct ``row``, so that no new name can clash."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from there.

    Later steps do not repeat the work above it, a lost executor takes nothing
    with it, and row numbers given before stay as they are.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(
    df: DataFrame, columns: list[str], fields: str, compute: Callable[..., Iterable]
) -> DataFrame:
    """Each row as ``row``, and beside it new columns from some of its own.

    ``compute`` takes a list of values per named column and returns one list
    per field.  It sees an Arrow batch at a time and no row moves.
    """
    rows = packed(df)
    at = [df.columns.index(c) for c in columns]
    new = StructType.fromDDL(fields)
    schema = StructType([StructField("row", rows.schema["row"].dataType, False), *new])
    kinds = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            out = compute(*[row.field(i).to_pylist() for i in at])
            arrays = [pa.array(x, type=t) for x, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([row, *arrays], names=["row", *new.names])

    return rows.mapInArrow(run, schema)


def in_slices(items: list, weight: Callable, most: int) -> Iterator[list]:
    """Consecutive items, as many as weigh ``most`` together, at least one."""
    part, total = [], 0
    for x in items:
        w = weight(x)
        if part and total + w > most:
            yield part
            part, total = [], 0
        part.append(x)
        total += w
    if part:
        yield part
