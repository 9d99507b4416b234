"""Tables kept for the length of a block, and tables small enough to hold locally."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

MAX_SMALL_ROWS = 10_000


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table for the fits inside the block; lost blocks are recomputed from its source."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def few_partitions(df: DataFrame, rows_per_partition: int = 20_000) -> DataFrame:
    """Merge the partitions of a table that has few rows. An iterative fit starts several jobs per
    tree; on a small table their tasks would cost more than their work."""
    return df.coalesce(max(1, math.ceil(df.count() / rows_per_partition)))


def small_table(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """A report-sized table as local rows, so that joining it never shuffles the other side.

    The size is checked, not assumed: more than ``max_rows`` rows are an error.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
