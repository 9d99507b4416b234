"""Descriptive statistics: profiles, rates by bin, candidate screening, proportion tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.functions.binning import cut_right
from secondcart.functions.distributions import normal_two_sided_p
from secondcart.operators.order_stats import exact_quantiles_of

# The reference value of the difference interval is this constant, not the exact quantile.
Z_95 = 1.96


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def source_profile(delivered: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows, exact number of persons and the period of a history."""
    return delivered.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(key).alias("n_persons"),
        F.to_date(F.min(ts)).alias("first_day"),
        F.to_date(F.max(ts)).alias("last_day"),
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, ties by value."""
    return frequency(df.where(F.col(column).isNotNull()), column).limit(1)


def rate_by(df: DataFrame, group: str, target: str = "target") -> DataFrame:
    """Positives, rows and rate per group; rows without a group are left out."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.sum(target).cast("bigint").alias("positives"),
            F.count(target).alias("total"),
            F.round(F.avg(target), 4).alias("rate"),
        )
    )


def rate_by_bin(
    df: DataFrame, bin_index: Column, labels: Sequence[str], target: str = "target"
) -> DataFrame:
    """Rates per ordered bin. Empty bins are listed with no rows and no rate."""
    spark = df.sparkSession
    bins = spark.createDataFrame(list(enumerate(labels)), "bin int, label string")
    rates = rate_by(df.withColumn("bin", bin_index), "bin", target)
    return bins.join(rates, "bin", "left").fillna({"positives": 0, "total": 0})


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Inner and outer edges of equal-count bins, duplicates dropped. A handful of numbers."""
    return _edges_of(exact_quantiles_of(df, {column: _bin_shares(bins)})[column])


def _bin_shares(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def _edges_of(quantiles: Sequence[float | None]) -> list[float]:
    return [] if quantiles[0] is None else sorted(set(quantiles))


def quantile_cut(df: DataFrame, column: str, bins: int) -> tuple[Column, int]:
    """Bin index of a value among equal-count, right-closed bins, and the number of bins.

    The lowest edge belongs to the first bin; duplicate edges make fewer bins.
    """
    edges = quantile_edges(df, column, bins)
    inner = edges[1:-1]
    return cut_right(F.col(column), inner), len(inner) + 1


def rate_by_quantile(
    df: DataFrame, column: str, labels: Sequence[str], target: str = "target"
) -> DataFrame:
    index, n_bins = quantile_cut(df, column, len(labels))
    return rate_by_bin(df, index, labels[:n_bins], target)


def screen_candidates(
    df: DataFrame, columns: Sequence[str], min_range: float, target: str = "target"
) -> DataFrame:
    """Spread of the target rate over the quartiles of each candidate, missing values at the
    median; a candidate is kept when the spread is above ``min_range``."""
    middles = exact_quantiles_of(df, {name: [0.5] for name in columns})
    values = {
        name: F.coalesce(F.col(name).cast("double"), F.lit(middles[name][0]).cast("double"))
        for name in columns
    }
    filled = df.select(target, *[v.alias(name) for name, v in values.items()])
    quartiles = exact_quantiles_of(filled, {name: _bin_shares(4) for name in columns})
    screened = []
    for name in columns:
        index = cut_right(F.col(name), _edges_of(quartiles[name])[1:-1])
        rates = filled.groupBy(index.alias("bin")).agg(F.avg(target).alias("rate"))
        screened.append(
            rates.agg(
                F.lit(name).alias("candidate"),
                (F.max("rate") - F.min("rate")).alias("rate_range"),
            )
        )
    spread = reduce(DataFrame.unionByName, screened)
    return spread.select(
        "candidate",
        F.round("rate_range", 6).alias("rate_range"),
        F.when(F.col("rate_range") > min_range, "keep").otherwise("drop").alias("decision"),
    )


def two_proportion_tests(
    df: DataFrame,
    comparisons: Mapping[str, tuple[Column, Column]],
    alpha: float = 0.05,
    target: str = "target",
) -> DataFrame:
    """Two-sided z test per comparison of two groups of rows, and a Bonferroni level.

    All groups are counted in one pass. The test statistic uses the pooled standard error, the
    interval of the difference the separate one.
    """
    counts = []
    for i, (a, b) in enumerate(comparisons.values()):
        for side, mask in (("a", a), ("b", b)):
            counts.append(F.count_if(mask).alias(f"n_{side}{i}"))
            counts.append(F.count_if(mask & (F.col(target) == 1)).alias(f"k_{side}{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("comparison"),
                *[
                    F.col(f"{what}_{side}{i}").alias(f"{what}_{side}")
                    for side in "ab"
                    for what in "nk"
                ],
            )
            for i, name in enumerate(comparisons)
        ]
    )
    n_a, k_a, n_b, k_b = (F.col(c) for c in ("n_a", "k_a", "n_b", "k_b"))
    share_a, share_b, pooled = F.col("share_a"), F.col("share_b"), F.col("pooled")
    difference, error = F.col("difference"), F.col("error")
    level = alpha / len(comparisons)
    return (
        df.agg(*counts)
        .select(F.inline(rows))
        .withColumns(
            {
                "share_a": F.try_divide(k_a, n_a),
                "share_b": F.try_divide(k_b, n_b),
                "pooled": F.try_divide(k_a + k_b, n_a + n_b),
            }
        )
        .withColumns(
            {
                "difference": share_a - share_b,
                "error": F.sqrt(
                    F.try_divide(share_a * (1 - share_a), n_a)
                    + F.try_divide(share_b * (1 - share_b), n_b)
                ),
                "z": F.try_divide(
                    share_a - share_b,
                    F.sqrt(
                        pooled
                        * (1 - pooled)
                        * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b))
                    ),
                ),
            }
        )
        .withColumn("p", normal_two_sided_p("z"))
        .select(
            "comparison",
            "n_a",
            "k_a",
            "n_b",
            "k_b",
            F.round("difference", 6).alias("difference"),
            F.round(difference - Z_95 * error, 6).alias("ci_low"),
            F.round(difference + Z_95 * error, 6).alias("ci_high"),
            F.round("z", 6).alias("z"),
            F.round("p", 6).alias("p"),
            F.round(F.lit(level), 6).alias("bonferroni_level"),
            (F.col("p") < level).alias("significant"),
        )
    )
