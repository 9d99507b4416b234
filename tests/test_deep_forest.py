"""A forest grown in the tasks, against a tree grown node by node and against MLlib."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.hashing import hash32
from secondcart.operators import deep_forest, metrics, models

COLUMNS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def rows(spark):
    def part(tag):
        return (hash32(3, tag, "id") % 101) / F.lit(101.0)

    df = spark.range(1500).select(
        F.col("id").cast("string").alias(models.ID),
        *[part(c).alias(c) for c in COLUMNS[:2]],
        (hash32(3, "x2", "id") % 3).cast("double").alias("x2"),
        part("noise").alias("noise"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    target = (F.col("x0") + F.col("x1") * F.col("x2") + F.col("noise") > 1.8).cast("int")
    return df.withColumn(models.LABEL, target).drop("noise").cache()


def scores_of(rows, node_draws, trees=5, depth=30):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    counts = models.class_counts(train)
    forest = deep_forest.DeepForest(trees, depth, 42)
    found = deep_forest.test_scores(
        forest, train, test, COLUMNS, models.ID, models.LABEL, counts.rows,
        counts.weights(models.BALANCED), node_draws,
    )
    return {r[models.ID]: r["score"] for r in found.collect()}


def test_no_forest_without_a_limit_is_fitted_on_the_driver(rows, monkeypatch):
    """The base forest's trees have as many nodes as rows: none of them may be an MLlib model."""

    def refused(spec, *args):
        raise AssertionError(f"{spec.name} is fitted whole")

    spec = models.base_models(COLUMNS, COLUMNS, Config().quick())[1]
    monkeypatch.setattr(models, "fit", refused)
    test = models.test_scores([spec], rows, Config().quick())
    assert test.count() == rows.where("split = 'test'").count()
    assert test.columns == ["model", models.ID, "label", "score"]


def test_scores_separate_the_classes_as_mllibs_do(rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    spec = models.grown_out_forest(COLUMNS, trees=20)
    ours = models.test_scores([spec], rows.withColumn("fold", F.lit(0)), Config().quick())
    theirs = models.score(spec, models.fit(spec, train), test)
    a, b = (metrics.ranking_metrics(x).first() for x in (ours, theirs))
    assert a["auc"] == pytest.approx(b["auc"], abs=0.05) and a["auc"] > 0.75


@pytest.mark.parametrize("node_draws", [1 << 14, 200, 20])
def test_upper_levels_on_counts_are_scored_whole(rows, node_draws):
    """Whatever is split in shared passes, each test row has one score, the same in every run."""
    found = scores_of(rows, node_draws)
    assert len(found) == 300 and all(0 <= s <= 1 for s in found.values())
    assert found == scores_of(rows.repartition(7), node_draws)
    assert len(set(found.values())) > 3


def test_limits_of_depth_hold_in_both_parts(rows):
    """Two levels can tell at most four leaves apart, above and below."""
    for node_draws in (1 << 14, 100):
        assert len(set(scores_of(rows, node_draws, trees=1, depth=2).values())) <= 4


def plain_tree(codes, n0, n1, x, weights, depth, key):
    """The share of one row, a node at a time."""
    node, used = 0, [0]
    at = np.zeros(len(codes), int)
    for level in range(depth + 1):
        mine = np.flatnonzero(at == node)
        a, b = n0[mine].sum() * weights[0], n1[mine].sum() * weights[1]
        share = b / (a + b)
        looked = deep_forest.looked_at(len(used), codes.shape[1], [*key, level])
        splits = {}
        for k, v in enumerate(used):
            own = np.flatnonzero(at == v)
            splits[v] = best_of(codes[own], n0[own], n1[own], looked[k], weights)
        if splits[node] is None or level == depth:
            return share
        new = np.full(len(codes), -1)
        for v, s in splits.items():
            own = np.flatnonzero(at == v)
            if s is not None:
                new[own] = 2 * v + (codes[own, s[0]] > s[1])
        used = sorted(set(new[new >= 0].tolist()))
        target = 2 * node + int(x[splits[node][0]] > splits[node][1])
        names = {v: i for i, v in enumerate(used)}
        at = np.array([names.get(v, -1) for v in new.tolist()])
        node, used = names[target], list(range(len(used)))
    raise AssertionError


def best_of(codes, n0, n1, looked, weights):
    def gini(a, b):
        return (a + b) - (a * a + b * b) / (a + b) if a + b else 0.0

    a, b = n0.sum() * weights[0], n1.sum() * weights[1]
    best, choice = 1e-9 * (a + b), None
    for f in looked:
        for c in range(deep_forest.CODES):
            left = codes[:, f] <= c
            if not left.any() or left.all():
                continue
            la, lb = n0[left].sum() * weights[0], n1[left].sum() * weights[1]
            gain = gini(a, b) - gini(la, lb) - gini(a - la, b - lb)
            if gain > best + 1e-7:
                best, choice = gain, (int(f), c)
    return choice


def test_levels_grown_together_equal_a_tree_grown_node_by_node():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 9, (40, 3))
    hit = rng.random(40) < 0.4
    n = rng.integers(1, 4, 40)
    n0, n1 = np.where(hit, 0, n), np.where(hit, n, 0)
    weights = (0.75, 1.5)
    # Every code is asked for, so that all nodes are grown in both.
    got = deep_forest.grown_below(codes, n0, n1, codes, weights, 6, [1, 2, 3])
    want = [plain_tree(codes, n0, n1, x, weights, 6, [1, 2, 3]) for x in codes]
    np.testing.assert_allclose(got, want)


def test_repeated_test_rows_keep_a_score_each(rows):
    twice = rows.unionAll(rows.where("split = 'test'").limit(10))
    spec = models.grown_out_forest(COLUMNS, trees=3)
    found = models.test_scores([spec], twice, Config().quick())
    assert found.count() == 310 and found.where("score < 0 or score > 1").count() == 0


def test_rows_are_drawn_once_on_average():
    hashes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000, np.int64)
    first, second = (deep_forest.draws(hashes, t) for t in (0, 1))
    assert first.mean() == pytest.approx(1, abs=0.03) and first.var() == pytest.approx(1, abs=0.06)
    assert (first != second).mean() > 0.5
