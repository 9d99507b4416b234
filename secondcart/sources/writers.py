"""Sinks: base tables, result tables, and tables that cut lineage between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, StructType

from secondcart.operators.caching import small_table
from secondcart.sources.readers import TIMESTAMP_FORMAT


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table of any size, one file per partition."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("timestampNTZFormat", TIMESTAMP_FORMAT)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.format(fmt).save(path)


def write_result(df: DataFrame, path: str, decimals: int | None = 4) -> None:
    """Write a small report as a single CSV file in its order, doubles rounded to ``decimals``.

    The report is computed in parallel and its size checked before it becomes one file.
    """
    if decimals is not None:
        doubles = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
        df = df.withColumns({name: F.round(name, decimals) for name in doubles})
    small_table(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or set on the context).

    Only a local session may fall back to a temporary folder: on a cluster other hosts could
    not read it, so an unset folder is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="secondcart-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/secondcart/{app}/{name}-{uuid.uuid4().hex}"


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written whole: Spark leaves a mark when its last task is done."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class PartTables:
    """One table that several jobs write side by side, each a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = new_path(spark, name)
        self.schema = None

    def add(self, number: int, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/part={number}")
        self.schema = df.schema

    def read(self) -> DataFrame:
        schema = StructType(self.schema.fields).add("part", IntegerType())
        return self.spark.read.schema(schema).parquet(self.path).drop("part")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs then scan a narrow Parquet table, with column pruning and statistics, instead of
    repeating the joins that built it, and losing an executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
