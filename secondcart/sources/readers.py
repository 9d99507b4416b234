"""Readers for the logical input tables (CSV or Parquet)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from secondcart.sources.quoted_csv import read_quoted_csv
from secondcart.sources.schemas import table_schema

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
PARSER_OPTIONS = {"timestampNTZFormat": TIMESTAMP_FORMAT, "mode": "FAILFAST"}


def read_csv(
    spark: SparkSession, path: str, schema: StructType, *, multiline_text: bool = False
) -> DataFrame:
    """CSV with a header. Columns are matched by header name order, types come from ``schema``.

    ``multiline_text`` is for free text whose quoted fields span lines. Counting the quotes takes
    a pass of its own, so it is off for every table that does not need it.
    """
    if multiline_text:
        return read_quoted_csv(spark, path, schema, PARSER_OPTIONS)
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.options(**PARSER_OPTIONS).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One logical table by name."""
    if fmt == "parquet":
        return read_parquet(spark, path, table_schema(name))
    if fmt == "csv":
        return read_csv(spark, path, table_schema(name), multiline_text=name == "reviews")
    raise ValueError(f"unsupported format {fmt!r}: use 'csv' or 'parquet'")


def read_tables(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Several logical tables: ``{"orders": path, "customers": path, ...}``."""
    return {name: read_table(spark, name, path, fmt) for name, path in paths.items()}
