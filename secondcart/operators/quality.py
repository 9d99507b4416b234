"""Data-quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(AssertionError):
    """A data-quality rule does not hold."""


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def assert_not_null(df: DataFrame, columns: Sequence[str]) -> None:
    bad = {c: n for c, n in not_null_violations(df, columns).first().asDict().items() if n}
    if bad:
        raise QualityError(f"missing values: {bad}")


def assert_unique(df: DataFrame, key: str) -> None:
    # Keys are counted per value first, so this is a two-step aggregation without a giant set.
    repeated = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise QualityError(f"{key} is not unique, e.g. {repeated[0][key]!r}")


def assert_same_count(before: DataFrame, after: DataFrame) -> None:
    n_before, n_after = before.count(), after.count()
    if n_before != n_after:
        raise QualityError(f"a join changed the number of rows: {n_before} to {n_after}")


def golden_differences(
    actual: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float
) -> DataFrame:
    """Every expected value with the actual one and whether they agree within ``tolerance``."""
    return expected.select(key, F.col(value).alias("expected")).join(
        actual.select(key, F.col(value).alias("actual")), key, "left"
    ).withColumn(
        "agrees",
        F.coalesce(F.abs(F.col("expected") - F.col("actual")) < tolerance, F.lit(False)),
    )


def assert_golden(
    actual: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float
) -> None:
    """Stops when a stored value is not reproduced."""
    bad = golden_differences(actual, expected, key, value, tolerance).where(~F.col("agrees"))
    rows = bad.limit(20).collect()
    if rows:
        raise QualityError("not reproduced: " + "; ".join(str(r.asDict()) for r in rows))
