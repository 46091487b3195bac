"""What the text operators share: results kept in the shared folder, and Arrow passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

BATCH_BYTES = 4 << 20


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at a time while a table is written: whole texts or sets stay within a few megabytes.
MOST_ROWS = 2048


def stored(df: DataFrame, purpose: str, rows: int = MOST_ROWS) -> DataFrame:
    """`df`, written to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    before = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, str(min(rows, before) if before > 0 else rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, str(before))
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that `column` holds about `most` bytes in each part; a longer single value is a part of its own."""
    start = size = 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield batch.slice(start)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """`fn` over the Arrow batches of each partition; it yields lists of columns of the given types."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)
