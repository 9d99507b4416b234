"""Metrics against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from secondcart.operators import metrics, sampling
from secondcart.operators.sampling import bootstrap_counts


def scored(spark, labels, scores, model="m"):
    rows = [(model, i, int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(rows, "model string, id long, label int, score double")


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return np.mean((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :]))


def brute_ap(y, s):
    total = 0.0
    recall = 0.0
    for t in sorted(set(s), reverse=True):
        chosen = s >= t
        r = y[chosen].sum() / y.sum()
        total += (r - recall) * y[chosen].mean()
        recall = r
    return total


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.2).astype(int)
    s = np.round(rng.random(600) + 0.3 * y, 2)  # many ties
    return y, s


@pytest.mark.parametrize("rows_per_window", [1, 10**6])
def test_rows_without_a_score_are_left_out(spark, rows_per_window):
    rows = [("m", 1, 1, 0.9), ("m", 2, 0, None), ("m", 3, 0, 0.2), ("m", 4, 1, 0.5)]
    df = spark.createDataFrame(rows, "model string, id long, label int, score double")
    got = metrics.ranking_metrics(df, rows_per_window=rows_per_window).first()
    assert (got["auc"], got["ap"]) == (1.0, 1.0)
    assert metrics.roc_curve(df).where("fpr > 1 or tpr > 1").isEmpty()
    assert metrics.lift_top(df, "id", 0.5, 1).first()["n_top"] == 2


@pytest.mark.parametrize("rows_per_window", [20, 10**6])
def test_auc_and_ap(spark, sample, rows_per_window):
    y, s = sample
    row = metrics.ranking_metrics(scored(spark, y, s), rows_per_window=rows_per_window).first()
    assert row["auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert row["ap"] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_reversed_scores_mirror_the_auc(spark, sample):
    y, s = sample
    a = metrics.roc_auc(scored(spark, y, s)).first()["auc"]
    b = metrics.roc_auc(scored(spark, y, -s)).first()["auc"]
    assert a + b == pytest.approx(1.0)


def test_constant_scores_and_one_class(spark):
    same = metrics.ranking_metrics(scored(spark, [0, 1, 0, 1], [0.5] * 4)).first()
    assert (same["auc"], same["ap"]) == (0.5, 0.5)
    one = metrics.ranking_metrics(scored(spark, [0, 0], [0.1, 0.2])).first()
    assert one["auc"] is None and one["ap"] is None


def test_f1_threshold_takes_the_lowest_of_equals(spark, sample):
    y, s = sample
    best = None
    for t in sorted(set(s)):
        chosen = s >= t
        p, r = y[chosen].mean(), y[chosen].sum() / y.sum()
        f1 = 2 * p * r / max(p + r, 1e-12)
        if best is None or f1 > best[1]:
            best = (t, f1)
    row = metrics.f1_threshold(scored(spark, y, s)).first()
    assert row["threshold"] == pytest.approx(best[0])
    assert row["f1"] == pytest.approx(best[1])
    # Both thresholds give F1 = 2/3.
    tied = metrics.f1_threshold(scored(spark, [1, 0, 0, 1], [0.9, 0.8, 0.7, 0.6])).first()
    assert tied["threshold"] == 0.6


def test_threshold_metrics_and_undefined_ratios(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.6, 0.5, 0.9])
    limits = spark.createDataFrame([("m", 0.5)], "model string, threshold double")
    row = metrics.confusion(df, limits).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 0, 2)
    high = spark.createDataFrame([("m", 2.0)], "model string, threshold double")
    row = metrics.threshold_metrics(df, high).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_lift_uses_ceil_and_is_whole_with_ties(spark, sample):
    y, s = sample
    row = metrics.lift_top(scored(spark, y[:595], s[:595]), "id", 0.1, 42).first()
    assert row["n_top"] == 60
    # With all scores tied, the chosen rows come from the hash order; their number is exact.
    tied = metrics.lift_top(scored(spark, y, np.zeros(600)), "id", 0.1, 42).first()
    assert tied["n_top"] == 60
    hits = round(tied["precision_top"] * 60)
    assert tied["capture_top"] == pytest.approx(hits / y.sum())
    # Without ties at the boundary the answer is plain.
    distinct = np.arange(600) / 600.0
    row = metrics.lift_top(scored(spark, y, distinct), "id", 0.1, 42).first()
    assert row["precision_top"] == pytest.approx(y[-60:].mean())
    assert row["lift_top"] == pytest.approx(y[-60:].mean() / y.mean())


def test_curves_keep_all_points(spark, sample):
    y, s = sample
    df = scored(spark, y, s)
    n = len(set(s)) + 1
    roc, pr = metrics.roc_curve(df), metrics.pr_curve(df)
    assert roc.count() == n and pr.count() == n
    assert roc.agg(F.max("tpr"), F.max("fpr")).first()[:] == (1.0, 1.0)
    assert pr.where("threshold is null").first()["precision"] == 1.0


def test_bootstrap_skips_one_class_replicates(spark):
    df = scored(spark, [1, 0, 0, 0], [0.9, 0.1, 0.2, 0.3])
    replicated = metrics.bootstrap_metrics(df, "id", 200, 42)
    n = replicated.count()
    # A replicate misses the single positive with probability (3/4)^4, about a third.
    assert 100 < n < 170
    ci = metrics.bootstrap_ci(replicated).first()
    assert ci["n_replicates"] == n and ci["auc_low"] == 1.0


@pytest.mark.parametrize("block_cells", [1 << 14, 8])
def test_bootstrap_replicates_match_resampling(spark, sample, block_cells):
    y, s = sample
    df = scored(spark, y[:80], s[:80])
    label = {i: (int(a), float(b)) for i, (a, b) in enumerate(zip(y[:80], s[:80], strict=True))}
    cells = {}
    for i, cell in label.items():
        cells.setdefault(cell, []).append(i)
    table = spark.createDataFrame(
        [(min(ids), len(ids), list(map(float, cell))) for cell, ids in cells.items()],
        "id long, n long, cell array<double>",
    )
    drawn = bootstrap_counts(table, "id", "n", "cell", 3, 42, block_cells)
    replicated = metrics.bootstrap_metrics(df, "id", 3, 42, block_cells)
    got = {r["replicate"]: r for r in replicated.collect()}
    by_replicate = {}
    for r in drawn.collect():
        by_replicate.setdefault(r["replicate"], []).extend([r["cell"]] * r["draws"])
    assert len(by_replicate) == 3
    for b, rows in by_replicate.items():
        yy, ss = np.array(rows).T
        assert len(rows) == 80
        assert got[b]["auc"] == pytest.approx(brute_auc(yy.astype(int), ss))
        assert got[b]["ap"] == pytest.approx(brute_ap(yy.astype(int), ss))


def test_draws_leave_a_task_as_sums_by_score():
    """A block of many cells with few scores makes a row a replicate with an entry a score, not a
    row for each cell that is drawn."""
    cells = [
        [("a", int(i % 3 == 0), float(i % 4)), ("b", int(i % 3 == 0), i / 1000.0)]
        for i in range(1000)
    ]
    kind = pa.list_(pa.struct([("model", pa.string()), ("label", pa.int32()), ("score", pa.float64())]))
    names = ("model", "label", "score")
    values = pa.array([[dict(zip(names, c, strict=True)) for c in own] for own in cells], kind)
    replicate = np.array([7] * 500 + [9] * 3)
    place = np.concatenate([np.arange(500), [0, 4, 999]])
    draws = np.concatenate([np.full(500, 2), [1, 5, 1]])
    (batch,) = metrics._score_counts(values)(replicate, place, draws)
    got = {r["replicate"]: r["counts"] for r in batch.to_pylist()}
    assert len([c for c in got[7] if c["model"] == "a"]) == 4 and len(got[7]) == 504
    assert sum(c["pos"] + c["neg"] for c in got[7] if c["model"] == "a") == 1000
    own = sorted((c["model"], c["score"], c["pos"], c["neg"]) for c in got[9])
    assert own == [
        ("a", 0.0, 1, 5), ("a", 3.0, 1, 0),
        ("b", 0.0, 1, 0), ("b", 0.004, 0, 5), ("b", 0.999, 1, 0),
    ]


def test_neighbours_share_a_digest():
    from hashlib import md5

    replicates, nodes = np.array([1, 1, 1, 1, 2, 2]), np.array([2, 3, 4, 7, 4, 5])
    got = sampling.split_uniforms(42, replicates, 5, nodes)
    for r, v, u in zip(replicates, nodes, got, strict=True):
        text = md5(f"42|split|{r}|5|{v >> 1}".encode()).hexdigest()
        assert u == int(text[15 * (v & 1) :][:15], 16) / float(1 << 60)


def test_spearman_with_ties_and_constants(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(400) < 0.35, 0.0, np.round(rng.random(400), 1))
    z = np.round(x + rng.random(400), 1)
    expected = pd.Series(x).rank().corr(pd.Series(z).rank())
    rows = [("a", float(p), float(q)) for p, q in zip(x, z, strict=True)]
    rows += [("b", 1.0, float(q)) for q in z[:20]]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["spearman"] for r in metrics.spearman(df, "x", "y", ["g"]).collect()}
    assert got["a"] == pytest.approx(expected, abs=1e-12)
    assert got["b"] is None


def test_classification_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 2), (2, 0)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(df, ["n", "u", "p"]).collect()}
    assert report["n"]["precision"] == 0.5 and report["n"]["recall"] == 0.5
    assert report["p"]["recall"] == pytest.approx(2 / 3) and report["p"]["support"] == 3
    assert report["accuracy"]["f1"] == pytest.approx(4 / 6)
    assert report["weighted average"]["recall"] == pytest.approx(4 / 6)
