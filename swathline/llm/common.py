"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a function sees at a time, so that what it holds of long texts stays small.
ROWS = 1000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_bytes(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column, so that Python tasks get bytes without decoding them first."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("string").cast("binary")


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to differ from all columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Runs ``make()`` once per task and the function it returns on every Arrow batch, in slices.

    The function returns columns by name; they are cast to ``schema``.
    """
    arrow = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                out = work(batch.slice(start, ROWS))
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker may idle through later stages

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
