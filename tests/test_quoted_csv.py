"""Records of quoted CSV files put together again from byte ranges."""

from __future__ import annotations

import csv
import random
from collections import Counter
from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql.types import StructType

from secondcart.sources import quoted_csv, readers

SCHEMA = "id INT, title STRING, message STRING, at TIMESTAMP_NTZ"
HEADER = "id,title,message,at\n"
AT = datetime(2018, 1, 2, 3, 4, 5)


@contextmanager
def ranges_of(spark, size: int):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read(spark, path):
    schema = StructType.fromDDL(SCHEMA)
    return readers.read_csv(spark, str(path), schema, multiline_text=True)


def by_one_task(spark, path):
    """Spark's reader that gives every file to one task."""
    return (
        spark.read.schema(SCHEMA).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').options(**readers.PARSER_OPTIONS)
        .csv(str(path))
    )


def made_rows(n: int, seed: int):
    rng = random.Random(seed)
    bits = ["\n", "\n\n", '"', '""', ",", " ", "a", "wörd", "\n\"\n", '",\n', "\r", "x" * 30]
    for k in range(n):
        message = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        yield k, rng.choice(["", "t", "two\nlines"]), message, rng.choice(["", str(AT)])


@pytest.mark.parametrize("size", [3, 64, 1 << 20])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_cuts_anywhere_give_the_rows_written(spark, tmp_path, size, ending):
    n = 8 if size == 3 else 60
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator=ending, quoting=csv.QUOTE_MINIMAL)
            writer.writerow(["id", "title", "message", "at"])
            writer.writerows(made_rows(n, part))
    expected = Counter(
        (k, title or None, message or None, AT if at else None)
        for part in range(2)
        for k, title, message, at in made_rows(n, part)
    )
    if ending == "\n":  # Spark's reader makes \r\n inside a field \n where lines end so
        assert Counter(map(tuple, by_one_task(spark, tmp_path).collect())) == expected
    with ranges_of(spark, size):
        found = read(spark, tmp_path)
        assert Counter(map(tuple, found.collect())) == expected
        assert found.schema == StructType.fromDDL(SCHEMA)


def test_a_long_field_goes_through_many_ranges(spark, tmp_path):
    path = tmp_path / "long.csv"
    text = "\n".join(f"line {k}, of ""many" for k in range(500))
    quoted = text.replace('"', '""')
    path.write_text(f'{HEADER}1,a,"{quoted}",\n2,b,c,\n\n3,,"""",\n')
    with ranges_of(spark, 100):
        df = read(spark, path)
        rows = sorted(map(tuple, df.collect()))
        assert quoted_csv._lines(spark, str(path)).rdd.getNumPartitions() > 50
    assert rows == [(1, "a", text, None), (2, "b", "c", None), (3, None, '"', None)]


def test_what_is_refused(spark, tmp_path):
    cases = {
        "odd": (f'{HEADER}1,a"b,c,\n', "odd number"),
        "stray": (f'{HEADER}1,a"b,c,\n2,d"e,f,\n', "unquoted"),
        "open": (f'{HEADER}1,a,"never closed,\n2,b,c,\n', "odd number"),
        "header": ("id,title,text,at\n1,a,b,\n", "header"),
        "type": (f"{HEADER}one,a,b,\n", "(?i)malformed|parse"),
        "short": (f"{HEADER}1,a\n", "(?i)malformed|parse"),
    }
    for name, (content, message) in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(content)
        with pytest.raises(Exception, match=message):
            read(spark, path).collect()


def test_empty_files_and_a_byte_order_mark(spark, tmp_path):
    for name, content, n in [("none", "", 0), ("header", HEADER, 0), ("one", f"{HEADER}1,a,b,", 1)]:
        path = tmp_path / f"{name}.csv"
        path.write_text(content, "utf-8-sig" if content else "utf-8")
        assert read(spark, path).count() == n
