"""Tables between jobs that prove themselves: a manifest says what was written.

The manifest is written last and renamed into place, so a table without one was not finished. It
holds the schema, the number of rows, the NULLs of each column and a content hash that does not
depend on the order of rows or on how they are spread over files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from secondcart.functions.hashing import hash60
from secondcart.operators.quality import QualityError

MANIFEST = "_manifest.json"
SEED = 42


def _encoded(name: str) -> Column:
    """A value as text with its length, so that neighbours cannot run into each other; NULL is
    told apart from every text."""
    text = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))


def content_manifest(df: DataFrame) -> DataFrame:
    """One row: ``n_rows``, ``n_nulls`` (array, one for each column) and ``content_hash``.

    The hash is the sum of a 60-bit hash of every row, so equal rows count as often as they occur.
    It is summed in the tasks. An empty table has the hash 0.
    """
    row = hash60(SEED, "row", *[_encoded(c) for c in df.columns])
    nulls = F.array(*[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
    total = F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return df.agg(
        F.count("*").alias("n_rows"),
        nulls.alias("n_nulls"),
        total.cast("decimal(38,0)").cast("string").alias("content_hash"),
    )


def manifest_of(df: DataFrame) -> dict:
    found = content_manifest(df).first().asDict()
    return {"schema": json.loads(df.schema.json()), **found}


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_checkpoint(df: DataFrame, path: str) -> None:
    """Write ``df`` in place of what lies at ``path``, then its manifest.

    The manifest is of the table as it reads back, so it also covers what a retried task has left.
    """
    spark = df.sparkSession
    place, files = _file(spark, f"{path}/{MANIFEST}")
    # Without its manifest the earlier table is refused from here on.
    files.delete(place, False)
    df.write.mode("overwrite").parquet(path)
    text = json.dumps(manifest_of(spark.read.schema(df.schema).parquet(path)))
    draft, _ = _file(spark, f"{path}/_manifest-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if not files.rename(draft, place):
        raise OSError(f"could not write {path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    place, files = _file(spark, f"{path}/{MANIFEST}")
    if not files.exists(place):
        raise QualityError(f"{path} has no manifest: it was not written to the end")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, if it is what its manifest says; it is read once to find out.

    A table without a manifest, or with files missing, added or changed, is refused.
    """
    expected = read_manifest(spark, path)
    df = spark.read.schema(StructType.fromJson(expected["schema"])).parquet(path)
    found = manifest_of(df)
    wrong = [key for key in expected if found.get(key) != expected[key]]
    if wrong:
        raise QualityError(f"{path} is not what its manifest says: {', '.join(wrong)}")
    return df
