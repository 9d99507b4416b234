"""Ranks, running totals, quantiles, splits and folds against brute force, in one window and in
many buckets, with hot values."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from secondcart.functions.hashing import hash32, hash60
from secondcart.operators import order_stats, sampling
from secondcart.operators.caching import small_table
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.operators.order_stats import (
    average_ranks,
    bucket_edges,
    dense_index,
    exact_quantiles,
    hash_cutoffs,
    running_totals,
)


@pytest.fixture(scope="module")
def values(spark):
    """20,000 rows; a third share one value, the rest are heavily skewed."""
    df = spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7.5)
        .otherwise(F.exp((hash32(1, "v", "id") % 100000) / 9000.0))
        .alias("v"),
        (F.col("id") % 4).alias("g"),
    )
    return df, np.array([r["v"] for r in df.select("v").collect()])


def test_hash_is_the_md5_prefix(spark):
    row = spark.range(7, 8).select(hash32(42, "1", "id"), hash60(42, "boot", F.lit(3), "id")).first()
    digest = hashlib.md5(b"42|boot|3|7").hexdigest()
    assert row[0] == 3254254507
    assert row[1] == int(digest[:15], 16)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_buckets_equal_one_window(values, descending):
    df, _ = values
    distinct = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    measures = {"upto": F.col("n")}
    edges = bucket_edges(distinct, "v", rows_per_window=500)
    assert len(edges) > 20
    one = running_totals(distinct, ["g"], "v", measures, descending)
    many = running_totals(distinct, ["g"], "v", measures, descending, edges=edges)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    assert many.agg(F.max("upto")).first()[0] == 5000


def test_null_groups_and_null_values_in_any_number_of_buckets(spark):
    rows = [(g, float(v), v % 3) for g in ("a", None) for v in range(50)]
    rows += [("a", None, 7), (None, None, 7)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    measures = {"upto": F.col("n")}
    one = running_totals(df, ["g"], "v", measures, edges=[])
    many = running_totals(df, ["g"], "v", measures, edges=[float(v) for v in range(0, 50, 3)])
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    totals = {r["g"]: r["m"] for r in many.groupBy("g").agg(F.max("upto").alias("m")).collect()}
    assert totals == {"a": 49, None: 49}


@pytest.mark.parametrize("limit", [30, 300, order_stats.COUNTS_PER_PASS])
def test_exact_quantiles(values, limit):
    df, v = values
    shares = [0.0, 0.01, 0.25, 0.3333, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "v", shares, limit).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(v, shares), rtol=1e-12)


ODD = [0.0, -0.0, 1.0, -1.0, 2.0**-1074, -(2.0**-1074), 2.0**-1022, 2.0**-1023, 1.7976931348623157e308,
       -1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 - 2.0**-53, 2 - 2.0**-52, 8.0, 1e-300]


def test_order_code_is_the_bits_of_a_double(spark):
    rng = np.random.default_rng(4)
    wide = rng.normal(size=3000) * 10.0 ** rng.integers(-320, 308, 3000)
    near = np.nextafter(2.0 ** rng.integers(-1022, 1023, 500), rng.choice([-np.inf, np.inf], 500))
    powers = 2.0 ** np.arange(-1074.0, 1024.0)
    x = np.concatenate([wide, near, powers, ODD])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = [r["c"] for r in df.select(order_stats.order_code(F.col("x")).alias("c")).collect()]
    bits = np.abs(x).view(np.int64)
    assert got == np.where(x < 0, -bits, bits).tolist()
    assert [order_stats.code_value(c) for c in got] == (x + 0.0).tolist()
    nan = spark.range(1).select(order_stats.order_code(F.lit(math.nan)).alias("c")).first()["c"]
    assert nan > max(got)


def test_quantiles_of_several_columns_in_the_same_passes(spark):
    rng = np.random.default_rng(5)
    a = np.where(rng.random(4000) < 0.3, 7.0, rng.normal(size=4000) * 1e6)
    b = rng.integers(-3, 3, 4000).astype(float)
    rows = [(float(p), int(q) if k % 5 else None, None) for k, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b long, c double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.901, 1.0]
    for limit in (16, 1 << 16):
        got = order_stats.exact_quantiles_of(df, {"a": shares, "b": [0.5], "c": [0.5]}, limit)
        np.testing.assert_allclose(got["a"], np.quantile(a, shares), rtol=1e-12)
        kept = [q for k, q in enumerate(b) if k % 5]
        assert got["b"] == [np.quantile(kept, 0.5)] and got["c"] == [None]


def test_selection_counts_and_nothing_else(values, spark):
    """A pass is one scan and one aggregation: no window, no sort, no join."""
    df, _ = values
    codes = df.select(F.lit(0).alias("column"), order_stats.order_code(F.col("v")).alias("code"))
    counted = order_stats.digit_counts(codes, [(0, 64, 0)], 48)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Window", "Sort", "Join"))
    assert counted.count() <= order_stats.COUNTS_PER_PASS


def test_quantiles_without_values(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(empty, "v", [0.5]).first()["quantiles"] == [None]


def test_average_ranks(spark):
    rows = [("a", 1.0, 2), ("a", 2.0, 1), ("a", 5.0, 3), ("b", 9.0, 4)]
    counts = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r["g"], r["v"]): (r["rank"], r["centered_rank"])
           for r in average_ranks(counts, "v", ["g"], "n").collect()}
    assert got == {
        ("a", 1.0): (1.5, -2.0), ("a", 2.0): (3.0, -0.5), ("a", 5.0): (5.0, 1.5),
        ("b", 9.0): (2.5, 0.0),
    }


def test_dense_index_has_no_gaps(values):
    df, _ = values
    indexed = dense_index(df, hash32(42, "row", "id"), "id")
    rows = indexed.select("id", "row_idx", hash32(42, "row", "id").alias("h")).collect()
    expected = sorted(rows, key=lambda r: (r["h"], r["id"]))
    assert [r["row_idx"] for r in expected] == list(range(len(rows)))


def test_hash_cutoffs_are_the_ranked_rows(values):
    df, _ = values
    cuts = hash_cutoffs(df, "g", hash32(1, "x", "id"), "id", lambda g, n: [1, n // 2, n, n + 5])
    for g, found in cuts.items():
        ordered = sorted(
            (r["h"], r["id"])
            for r in df.where(F.col("g") == g).select(hash32(1, "x", "id").alias("h"), "id").collect()
        )
        assert found == [ordered[0], ordered[2499], ordered[4999]]


def test_split_is_stratified_and_stable(values):
    df, _ = values
    split = sampling.stratified_split(df, "id", "g", 0.2, 42)
    counts = {(r["g"], r["split"]): r["count"] for r in split.groupBy("g", "split").count().collect()}
    assert all(counts[(g, "test")] == 1000 and counts[(g, "train")] == 4000 for g in range(4))
    again = sampling.stratified_split(df.repartition(7), "id", "g", 0.2, 42)
    assert split.exceptAll(again).isEmpty()


def test_split_rounds_to_nothing_for_a_tiny_stratum(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(10)], "id long, g int")
    split = sampling.stratified_split(df, "id", "g", 0.2, 42)
    assert split.where("g = 1").first()["split"] == "train"
    assert split.where("split = 'test'").count() == 2


def _plain_places(rows, seed, tag):
    """Place of every row in its stratum, by the hash and then the id, and rows per stratum."""
    by = {}
    for i, g in rows:
        digest = hashlib.md5(f"{seed}|{tag}|{i}".encode()).hexdigest()[:8]
        by.setdefault(g, []).append((int(digest, 16), i))
    return {i: (k, len(own)) for own in by.values() for k, (_, i) in enumerate(sorted(own))}


def test_any_number_of_strata(spark, values, monkeypatch):
    """More strata than the driver looks at: the same rows, from a joined table."""
    df = values[0].select("id", F.when(F.col("id") % 50 != 0, F.col("id") % 7).alias("g"))
    plain = {
        "split": sampling.stratified_split(df, "id", "g", 0.2, 42),
        "fold": sampling.stratified_folds(df, "id", "g", 5, 42, within=F.col("id") % 3 > 0),
    }
    expected = {name: bag.collect() for name, bag in plain.items()}
    monkeypatch.setattr(order_stats, "MAX_STRATA", 0)
    joined = {
        "split": sampling.stratified_split(df, "id", "g", 0.2, 42),
        "fold": sampling.stratified_folds(df, "id", "g", 5, 42, within=F.col("id") % 3 > 0),
    }
    for name, rows in expected.items():
        assert set(map(tuple, joined[name].collect())) == set(map(tuple, rows))


def test_a_hundred_thousand_strata(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "MAX_STRATA", 16)
    # A third of the rows in one stratum, the others in strata of one to three rows.
    g = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100_000)
    df = spark.range(300_000).select("id", g.alias("g"))
    split = sampling.stratified_split(df, "id", "g", 0.2, 42)
    folds = sampling.stratified_folds(df, "id", "g", 5, 42)
    rows = [(r["id"], r["g"], r["split"]) for r in split.collect()]
    assert len(rows) == 300_000 and len({g for _, g, _ in rows}) == 100_001
    places = _plain_places([r[:2] for r in rows], 42, "split")
    for i, _, half in rows:
        place, n = places[i]
        assert (half == "test") == (place < math.floor(0.2 * n + 0.5))
    places = _plain_places([r[:2] for r in rows], 42, "fold")
    for r in folds.collect():
        place, n = places[r["id"]]
        assert r["fold"] == sum(place + 1 > e for e in set(sampling._tile_ends(n, 5)) if e > 0)


def test_folds_cover_each_row_once_and_are_even(values):
    df, _ = values
    odd = df.where("id < 1003")
    folds = sampling.stratified_folds(odd, "id", "g", 5, 42)
    assert folds.count() == 1003
    for g in range(4):
        sizes = [r["count"] for r in folds.where(F.col("g") == g).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_folds_of_fewer_rows_than_folds(spark):
    df = spark.createDataFrame([(i, 0) for i in range(3)], "id long, g int")
    folds = sampling.stratified_folds(df, "id", "g", 5, 42)
    assert sorted(r["fold"] for r in folds.collect()) == [0, 1, 2]


def test_hash_sample_size(values):
    df, _ = values
    sample = sampling.hash_sample(df, "id", 3000, 42)
    assert sample.count() == 3000 and sample.select("id").distinct().count() == 3000
    assert sampling.hash_sample(df, "id", 10**6, 42).count() == 20_000


@pytest.mark.parametrize("block_cells, fan_out", [(1 << 14, 64), (4, 3)])
def test_bootstrap_counts(values, monkeypatch, block_cells, fan_out):
    """Counts have the means, variances and covariances of plain resampling."""
    monkeypatch.setattr(sampling.draws_per_block, "__defaults__", (fan_out,))
    spark = values[0].sparkSession
    weights = [1, 1, 5, 30, 1, 2, 400, 1, 1, 8, 50, 1, 3]
    n, replicates = sum(weights), 600
    rows = [(k, w, f"v{k}") for k, w in enumerate(weights)]
    cells = spark.createDataFrame(rows, "id long, w long, v string").repartition(3)
    drawn = sampling.bootstrap_counts(cells, "id", "w", "v", replicates, 42, block_cells)
    counts = np.zeros((replicates, len(weights)))
    for r in drawn.collect():
        assert r["draws"] > 0 and counts[r["replicate"], int(r["v"][1:])] == 0
        counts[r["replicate"], int(r["v"][1:])] = r["draws"]
    assert (counts.sum(axis=1) == n).all()
    again = sampling.bootstrap_counts(cells.repartition(1), "id", "w", "v", replicates, 42, block_cells)
    assert again.exceptAll(drawn).isEmpty()
    rng = np.random.default_rng(1)
    plain = rng.multinomial(n, np.array(weights) / n, 20_000)
    spread = plain.std(axis=0)
    assert (np.abs(counts.mean(axis=0) - weights) < 4 * spread / math.sqrt(replicates)).all()
    assert (np.abs(counts.var(axis=0) / plain.var(axis=0) - 1) < 0.3).all()
    apart = np.corrcoef(counts.T) - np.corrcoef(plain.T)
    assert np.abs(apart).max() < 4.5 / math.sqrt(replicates)


def test_binomial_inverse_follows_the_distribution():
    rng = np.random.default_rng(2)
    for n, p in [(1, 0.3), (7, 0.5), (40, 0.97), (3000, 0.5), (3000, 0.001), (5, 0.0), (5, 1.0)]:
        table = np.array([math.lgamma(i + 1) for i in range(n + 1)])
        u = rng.random(4000)
        k = sampling.binomial_inverse(np.full(4000, n), np.full(4000, p), u, table)
        assert k.min() >= 0 and k.max() <= n
        assert abs(k.mean() - n * p) <= 4.5 * math.sqrt(n * p * (1 - p) / 4000)
        if 0 < p < 1:
            # Inversion: the distribution function at k exceeds u, and at k - 1 does not.
            mass = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)] if n < 50 else None
            if mass:
                upto = np.cumsum(mass)
                assert (upto[k] > u - 1e-12).all()
                assert (np.where(k > 0, upto[np.maximum(k - 1, 0)], 0) <= u + 1e-12).all()


def test_lookup_by_hot_key_matches_a_plain_join(values):
    df, _ = values
    left = df.select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = lookup_by_hot_key(left, right, "k", "n", hot_share=4, salts=8)
    plain = left.join(right, "k", "left")
    assert got.count() == 20_000
    assert got.select(plain.columns).exceptAll(plain).isEmpty()


def test_a_hot_key_is_spread_over_many_tasks(values):
    df, _ = values
    left = df.select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    spark = left.sparkSession
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                            "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = lookup_by_hot_key(left, right, "k", "n")
        tasks = joined.where("k = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)
    assert len(tasks) == 8  # all shuffle partitions of this session
    assert max(t["count"] for t in tasks) < 20_000 // 3 // 2


def test_small_table_refuses_large_input(spark):
    assert small_table(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        small_table(spark.range(6), 5)
