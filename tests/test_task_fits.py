"""Ensembles grown whole in tasks, and the sequential search that is made of them."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.hashing import hash32
from secondcart.operators import deep_forest, metrics, models, parzen, task_fits
from secondcart.plans.queries import QUERY_CONFIG

COLUMNS = ["x0", "x1", "x2"]
CONFIG = replace(Config(), cv_folds=3, bootstrap_replicates=20)
SMALL = replace(CONFIG.quick(), cv_folds=3)


@pytest.fixture(scope="module")
def train(spark):
    ids = spark.range(900).select(F.col("id").cast("string").alias(models.ID))
    df = ids.select(
        models.ID,
        *[(hash32(4, c, models.ID) % 50).cast("double").alias(c) for c in COLUMNS],
        (hash32(4, "noise", models.ID) % 40).alias("noise"),
        (hash32(4, "fold", models.ID) % 3).cast("int").alias("fold"),
    )
    target = (F.col("x0") + F.col("x1") * F.col("x2") / 20 + F.col("noise") > 95).cast("int")
    return df.withColumn("target", target).drop("noise").cache()


def by_id(scores):
    return {(r["model"], r[models.ID], r["fold"]): r["score"] for r in scores.collect()}


def test_scores_are_those_of_trees_that_grow_in_passes(train, monkeypatch):
    """Whole in a task or level by level over all tasks: the same draws, splits and leaves."""
    specs = [
        models.boosting(COLUMNS, "a", trees=6, depth=5, row_share=0.8, feature_share=0.6),
        models.boosting(COLUMNS[1:], "b", trees=4, depth=4, rate=0.1, min_leaf=20),
        models.forest(COLUMNS, "c", trees=7, depth=9, min_leaf=4, feature_share=0.5).grown_in_tasks(),
        models.grown_out_forest(COLUMNS, "d", trees=4),
    ]
    monkeypatch.setattr(task_fits, "TREES_PER_TASK", 3)
    whole = by_id(models.oof_scores(specs, train.repartition(5), CONFIG))
    assert len(whole) == 4 * train.count()
    monkeypatch.setattr(task_fits, "FIT_ROWS", 0)
    passes = by_id(models.oof_scores(specs, train, CONFIG))
    assert whole.keys() == passes.keys()
    assert all(passes[key] == pytest.approx(score, abs=1e-6) for key, score in whole.items())


def test_every_fit_has_a_task_of_its_own(train):
    table = models.coded_for_search(train, COLUMNS, CONFIG)
    fits = [
        task_fits.Fit(str(k), tuple(COLUMNS), models.boosting(COLUMNS, trees=2).boosted, k % 3, (1.0, 2.0))
        for k in range(12)
    ]
    dealt = task_fits._dealt(table, fits, [(k, 0, 2) for k in range(12)])
    found = dealt.select(F.spark_partition_id().alias("p"), "piece").distinct().collect()
    assert sorted((r["p"], r["piece"]) for r in found) == [(k, k) for k in range(12)]


def test_nodes_in_blocks_give_the_same_trees(monkeypatch):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 30, (3000, 4)).astype(np.uint8)
    hit = rng.random(3000) < 0.3 + 0.01 * codes[:, 0]
    n = rng.integers(1, 4, 3000)
    args = (codes, np.where(hit, 0, n), np.where(hit, n, 0), codes, (0.75, 1.5), 30, [1, 2], 2, 0.5)
    whole = deep_forest.grown_below(*args)
    monkeypatch.setattr(deep_forest, "NODES_AT_ONCE", 7)
    np.testing.assert_array_equal(deep_forest.grown_below(*args), whole)
    assert len(np.unique(whole)) > 10


def test_leaves_have_their_least_draws():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 30, (400, 3))
    hit = rng.random(400) < 0.5
    n = np.ones(400, int)
    for least in (1, 25):
        found = deep_forest.grown_below(
            codes, np.where(hit, 0, n), np.where(hit, n, 0), codes, (1.0, 1.0), 30, [1], least, 1.0
        )
        sizes = np.unique(found, return_counts=True)[1]
        assert sizes.min() >= least
    assert len(sizes) > 3


def test_repeated_and_missing_ids_have_a_score_each(train):
    holed = train.withColumn(models.ID, F.when(F.col("x0") > 5, F.col(models.ID)))
    twice = holed.unionAll(holed)
    specs = [
        models.boosting(COLUMNS, "a", trees=3, depth=2),
        models.forest(COLUMNS, "b", trees=60, depth=4).grown_in_tasks(),
    ]
    found = models.oof_scores(specs, twice, CONFIG)
    assert found.count() == 4 * train.count()
    assert found.where("score is null or score < 0 or score > 1").count() == 0


def test_no_query_has_fewer_trees_trials_or_folds(train):
    """Base models grew a tenth of their trees in the queries, searched ones a fiftieth."""
    assert QUERY_CONFIG == Config()
    trees = [s.ensemble.trees for s in models.base_models(COLUMNS, COLUMNS, QUERY_CONFIG)[1:]]
    assert trees == [300, 300, 300]
    for space in models.SEARCH_SPACES:
        own = space.ranges["trees"]
        drawn = [t["trees"] for t in models.draw_trials(space, QUERY_CONFIG)]
        assert len(drawn) == 30 and own.low <= min(drawn) and max(drawn) <= own.high


def test_every_trial_is_scored_on_all_folds_with_all_trees(train, tmp_path, monkeypatch):
    """The search went by one fold and a quarter of the trees for most of its trials."""
    seen = []
    plain = models.oof_scores

    def watched(specs, rows, config, folds=None, table=None):
        seen.extend((s.ensemble.trees, folds) for s in specs)
        return plain(specs, rows, config, folds, table)

    monkeypatch.setattr(models, "oof_scores", watched)
    monkeypatch.setattr(parzen, "STARTUP", 3)
    # Where no step of an earlier run is found.
    monkeypatch.setattr(models, "shared_folder", lambda spark: str(tmp_path))
    space = models.SEARCH_SPACES[0]
    config = replace(SMALL, search_trials=5)
    table = models.coded_for_search(train, COLUMNS, config)
    result = models.sequential_search(space, train, COLUMNS, config, table)
    assert seen == [(t.drawn["trees"], None) for t in result.trials] and len(seen) == 5
    assert result.trials[0].drawn == models.draw_trials(space, config)[0]
    spec = space.make(COLUMNS, "alone", **result.trials[4].drawn, seed=config.seed)
    alone = metrics.average_precision(
        plain([spec.grown_in_tasks()], train, config), ("model", "fold")
    ).collect()
    assert len(alone) == 3
    assert result.trials[4].mean_ap == pytest.approx(np.mean([r["ap"] for r in alone]), abs=1e-9)
    # A driver that starts again reads the steps and fits nothing.
    monkeypatch.setattr(models, "oof_scores", None)
    again = models.sequential_search(space, train, COLUMNS, config, table)
    assert again == result


@pytest.mark.parametrize("log, integer", [(False, False), (True, False), (True, True), (False, True)])
def test_densities_add_up_to_one(log, integer):
    scale = parzen.Scale(1, 12, log, integer)
    mixture = parzen.Mixture([2, 3, 3, 9, 12], scale)
    if integer:
        total = sum(np.exp(mixture.log_density(v)) for v in range(1, 13))
    else:
        x = np.linspace(*scale.ends, 4001)
        p = [np.exp(mixture.log_density(np.exp(v) if log else v)) for v in x]
        total = np.trapezoid(p, x)
    assert total == pytest.approx(1, abs=1e-4)
    rng = random.Random(3)
    drawn = [mixture.draw(rng) for _ in range(300)]
    assert min(drawn) >= 1 and max(drawn) <= 12
    assert not integer or all(isinstance(v, int) for v in drawn)


def test_proposals_gather_where_scores_are_best():
    """Sequential proposals come nearer to the best place than as many random draws."""
    scales = {"a": parzen.Scale(0.0, 1.0, False, False), "n": parzen.Scale(1, 100, True, True)}

    def worth(t):
        return -abs(t["a"] - 0.3) - abs(np.log(t["n"] / 20)) / 5

    rng = random.Random(1)
    trials = [{"a": rng.random(), "n": rng.randint(1, 100)} for _ in range(parzen.STARTUP)]
    for _ in range(40):
        trials.append(parzen.proposed(scales, trials, [worth(t) for t in trials], rng))
    first, last = trials[: parzen.STARTUP], trials[-15:]
    assert np.mean([worth(t) for t in last]) > np.mean([worth(t) for t in first])
    assert max(worth(t) for t in trials) > -0.1
    assert all(0 <= t["a"] <= 1 and 1 <= t["n"] <= 100 for t in trials)
