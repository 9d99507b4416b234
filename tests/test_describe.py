"""Bins, rates, screening and proportion tests."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondcart.functions import distributions
from secondcart.functions.binning import cut_right, label_of
from secondcart.functions.lookups import (
    CATEGORY_DURABILITY,
    DELIVERY_EDGES,
    DELIVERY_LABELS,
    QUARTILE_LABELS,
)
from secondcart.operators import describe
from tests.tails import chi_square_upper, normal_two_sided


def test_durability_map_is_complete():
    values = list(CATEGORY_DURABILITY.values())
    assert len(values) == 71 and values.count(0) == 26


def test_fixed_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, -1.0, -0.5, 4.0, 4.5, 14.0, 15.0, None)], "v double")
    index = cut_right(F.col("v"), DELIVERY_EDGES)
    got = [tuple(r) for r in df.select(index, label_of(index, DELIVERY_LABELS)).collect()]
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 3, 4, None]
    assert got[0][1] == "late" and got[6][1] == "15 or more days early" and got[7][1] is None


def test_empty_bins_are_listed(spark):
    df = spark.createDataFrame([(-3.0, 1), (20.0, 0), (20.0, 1), (None, 1)], "v double, target int")
    rates = describe.rate_by_bin(df, cut_right(F.col("v"), DELIVERY_EDGES), DELIVERY_LABELS)
    rows = {r["bin"]: r for r in rates.collect()}
    assert len(rows) == 5
    assert (rows[2]["total"], rows[2]["positives"], rows[2]["rate"]) == (0, 0, None)
    assert (rows[4]["total"], rows[4]["rate"]) == (2, 0.5)


def test_quartiles_with_duplicate_edges_make_fewer_bins(spark):
    # 60% of the values are 1: the lower edges coincide and are dropped.
    values = [1.0] * 60 + [float(v) for v in range(2, 42)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, target int")
    index, n_bins = describe.quantile_cut(df, "v", 4)
    counts = {r["b"]: r["count"] for r in df.groupBy(index.alias("b")).count().collect()}
    edges = sorted(set(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])))
    assert n_bins == len(edges) - 1 == 2
    assert counts == {0: sum(v <= edges[1] for v in values), 1: sum(v > edges[1] for v in values)}
    assert describe.rate_by_quantile(df, "v", QUARTILE_LABELS).count() == 2


def test_frequency_and_mode_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "s string")
    assert describe.mode(df, "s").first()["s"] == "a"
    assert describe.frequency(df, "s").first()["n"] == 3


def test_two_proportions(spark):
    rows = [(0, 1)] * 30 + [(0, 0)] * 70 + [(1, 1)] * 20 + [(1, 0)] * 180 + [(2, 1)] * 7
    df = spark.createDataFrame(rows, "g int, target int")
    comparisons = {
        "0 / 1": (F.col("g") == 0, F.col("g") == 1),
        "0 / none": (F.col("g") == 0, F.col("g") == 9),
    }
    got = {r["comparison"]: r for r in describe.two_proportion_tests(df, comparisons).collect()}
    a, b, pool = 0.3, 0.1, 50 / 300
    z = (a - b) / math.sqrt(pool * (1 - pool) * (1 / 100 + 1 / 200))
    error = math.sqrt(a * (1 - a) / 100 + b * (1 - b) / 200)
    row = got["0 / 1"]
    assert row["z"] == pytest.approx(z, abs=1e-6)
    assert row["p"] == pytest.approx(normal_two_sided(z), abs=1e-6)
    assert row["ci_low"] == pytest.approx(a - b - 1.96 * error, abs=1e-6)
    assert row["bonferroni_level"] == 0.025 and row["significant"]
    assert got["0 / none"]["z"] is None and got["0 / none"]["p"] is None


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 10, 11])
@pytest.mark.parametrize("x", [0.5, 3.0, 12.0, 40.0])
def test_chi_square_tail(df, x):
    t = np.linspace(x, x + 400, 800_001)
    density = t ** (df / 2 - 1) * np.exp(-t / 2) / (2 ** (df / 2) * math.gamma(df / 2))
    assert chi_square_upper(x, df) == pytest.approx(np.trapezoid(density, t), rel=1e-5)


# Published 0.05 and 0.001 points of chi-square, and the normal's.
PUBLISHED = [(1, 3.841459, 0.05), (2, 5.991465, 0.05), (10, 18.307038, 0.05), (11, 19.675138, 0.05),
             (1, 10.827566, 0.001), (10, 29.588298, 0.001), (30, 43.772972, 0.05)]


def test_tail_columns(spark):
    """Column expressions against sums and the error function, and no Python in the plan."""
    rows = [(float(x), df) for df in (1, 2, 3, 10, 11, 40, 120) for x in
            (-1, 0, 1e-9, 0.3, 1, 5, 11.9, 12.1, 40, 41.5, 130, 600)]
    rows += [(x, df) for df, x, _ in PUBLISHED]
    table = spark.createDataFrame(rows, "x double, df int")
    p = distributions.chi_square_upper_p(F.col("x"), F.col("df"))
    got = table.withColumn("p", p)
    for r in got.collect():
        assert r["p"] == pytest.approx(chi_square_upper(r["x"], r["df"]), rel=1e-9, abs=1e-300)
    for r, (_, _, level) in zip(got.collect()[-len(PUBLISHED):], PUBLISHED, strict=True):
        assert r["p"] == pytest.approx(level, rel=1e-6)
    zs = [(float(z),) for z in (-12, -1.959963984540054, -0.1, 0, 1e-8, 0.5, 2, 6, 30)] + [(None,)]
    normal = spark.createDataFrame(zs, "z double").withColumn(
        "p", distributions.normal_two_sided_p("z")
    )
    for r in normal.collect():
        expected = None if r["z"] is None else pytest.approx(normal_two_sided(r["z"]), rel=1e-9)
        assert r["p"] == expected
    assert "Python" not in normal._jdf.queryExecution().executedPlan().toString()
    a = spark.createDataFrame([(v,) for v in (0.5, 1.0, 1.5, 2.0, 7.25, 60.0)], "a double")
    for r in a.withColumn("g", distributions.log_gamma(F.col("a"))).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["a"]), rel=1e-12, abs=1e-13)


def test_normal_tail_far_out():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert 0 < normal_two_sided(-12.0) < 1e-30
