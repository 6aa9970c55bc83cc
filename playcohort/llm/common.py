"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one Arrow batch holds at most. A batch is what a Python worker keeps in memory.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that reach Python small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType | str
) -> DataFrame:
    """Apply ``function`` to each Arrow batch, given and returned as columns of Python values.

    ``function`` is called once per batch of at most ``BATCH_ROWS`` rows; a task never holds
    more than one batch. An empty table gives an empty table.
    """
    bounded_batches(df.sparkSession)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            out = function(columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[field.name], type=field.type) for field in target], schema=target
            )

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that no column of ``df`` has (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(
    df: DataFrame, inputs: list[str], function: Callable[..., dict[str, list]], added: T.StructType
) -> DataFrame:
    """``df`` with columns that ``function`` computes from the values of the ``inputs`` of a batch.

    All other columns pass through as Arrow arrays, never as Python values. The names in
    ``added`` must be new (see ``fresh``).
    """
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *added.fields])
    new = arrow_schema(added)
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(*[batch.column(i).to_pylist() for i in at])
            more = [pa.array(out[field.name], type=field.type) for field in new]
            names = [*batch.schema.names, *new.names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return df.mapInArrow(run, schema)
