"""Tables with manifests: whole ones are read, others refused."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from secondcart.operators.quality import QualityError
from secondcart.sources.checkpoints import (
    content_manifest,
    read_checkpoint,
    read_manifest,
    write_checkpoint,
)

SCHEMA = "k long, name string, value double, at timestamp_ntz, tags array<string>, `a.b` int"


def table(spark):
    rows = [(k, None if k % 5 == 0 else f"n|{k}", k / 3, None, ["x"], k % 2) for k in range(200)]
    return spark.createDataFrame(rows + rows[:7], SCHEMA)


def test_a_whole_table_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark)
    write_checkpoint(df, path)
    back = read_checkpoint(spark, path)
    assert back.schema == df.schema and back.exceptAll(df).isEmpty() and back.count() == 207
    manifest = read_manifest(spark, path)
    assert manifest["n_rows"] == 207 and manifest["n_nulls"][:4] == [0, 42, 0, 207]
    # written again, another table is there
    write_checkpoint(df.limit(3), path)
    assert read_checkpoint(spark, path).count() == 3


def test_the_hash_is_of_rows_not_of_files(spark):
    df = table(spark)
    of = lambda x: content_manifest(x).first()["content_hash"]
    assert of(df) == of(df.repartition(5).orderBy(F.desc("k"), "name"))
    assert of(df) != of(df.dropDuplicates(["k"]))
    assert of(df) != of(df.withColumn("name", F.coalesce("name", F.lit(""))))
    one, two = (spark.createDataFrame([r], "a string, b string") for r in [("x|1:y", "z"), ("x", "y|z")])
    assert of(one) != of(two)
    assert of(df.limit(0)) == "0"


def test_half_written_and_altered_tables_are_refused(spark, tmp_path):
    path = tmp_path / "t"
    write_checkpoint(table(spark).repartition(4), str(path))

    def copy(name):
        shutil.copytree(path, tmp_path / name)
        return tmp_path / name

    half = copy("half")
    (half / "_manifest.json").unlink()
    with pytest.raises(QualityError, match="no manifest"):
        read_checkpoint(spark, str(half))
    fewer = copy("fewer")
    next(fewer.glob("part-*")).unlink()
    with pytest.raises(QualityError, match="n_rows"):
        read_checkpoint(spark, str(fewer))
    altered = copy("altered")
    other = table(spark).withColumn("value", F.when(F.col("k") == 3, 9.0).otherwise(F.col("value")))
    other.write.parquet(str(tmp_path / "other"))
    for file in altered.glob("*part-*"):
        file.unlink()
    for file in (tmp_path / "other").glob("part-*"):
        shutil.copy(file, altered)
    with pytest.raises(QualityError, match="content_hash"):
        read_checkpoint(spark, str(altered))
    # a write that fails leaves no manifest behind
    failing = table(spark).withColumn("k", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        write_checkpoint(failing, str(path))
    with pytest.raises(QualityError, match="no manifest"):
        read_checkpoint(spark, str(path))
