"""Every query with an SQL equivalent gives the same rows in Spark and in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(repr(plain(row[i])) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(lines)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, duck, folder, name):
    result = contract.queries()[name](spark, folder)
    spark_columns, spark_rows = canonical(result.columns, result.collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    sql_columns, sql_rows = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert spark_columns == sql_columns
    assert len(spark_rows) == len(sql_rows)
    assert len(spark_rows) > 0
    different = [(a, b) for a, b in zip(spark_rows, sql_rows, strict=True) if a != b]
    assert not different, different[:5]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    row = contract.entry(spark).first()
    # Counts confirmed for this folder by two engines before this package existed.
    assert (row["n_customers"], row["n_eligible"], row["n_known_before"]) == (145, 143, 6)
    assert (row["n_sample"], row["n_positive"]) == (137, 26)
