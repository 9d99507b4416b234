"""Boosted trees that grow together, against trees grown one row at a time."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.hashing import hash32
from secondcart.operators import joint_boosting, metrics, models

COLUMNS = ["x0", "x1", "x2"]
CONFIG = replace(Config().quick(), cv_folds=3)


@pytest.fixture(scope="module")
def train(spark):
    """Few values per column, so that MLlib's thresholds and the edges are the same."""
    ids = spark.range(1200).select(F.col("id").cast("string").alias(models.ID))
    df = ids.select(
        models.ID,
        *[(hash32(3, c, models.ID) % 20).cast("double").alias(c) for c in COLUMNS],
        (hash32(3, "noise", models.ID) % 30).alias("noise"),
        (hash32(3, "fold", models.ID) % 3).cast("int").alias("fold"),
    )
    target = (F.col("x0") + F.col("x1") * F.col("x2") / 10 + F.col("noise") > 55).cast("int")
    return df.withColumn("target", target).drop("noise").cache()


def by_id(scores):
    return {(r["model"], r[models.ID]): r["score"] for r in scores.collect()}


def test_scores_are_those_of_mllib(train):
    """Without random draws both grow the same trees, whatever the fits that grow beside."""
    specs = [
        models.boosting(COLUMNS, "a", trees=4, depth=3, rate=0.2, min_leaf=5),
        models.boosting(COLUMNS[1:], "b", trees=2, depth=4, rate=0.1, min_leaf=9),
    ]
    got = by_id(models.oof_scores(specs, train, CONFIG))
    assert len(got) == 2 * train.count()
    for spec in specs:
        for k in range(3):
            model = models.fit(spec, train.where(F.col("fold") != k))
            alone = by_id(models.score(spec, model, train.where(F.col("fold") == k)))
            gaps = np.array([abs(got[key] - score) for key, score in alone.items()])
            # Splits of equal gain may be chosen in another order.
            assert np.mean(gaps < 1e-5) > 0.9


def test_no_fit_of_boosted_trees_is_alone(train, monkeypatch):
    """A search used to start a chain of jobs for each of its fits."""

    def alone(*args):
        raise AssertionError("a fit of its own")

    monkeypatch.setattr(GBTClassifier, "_fit", alone)
    specs = [
        models.boosting(
            COLUMNS, str(i), trees=2 + i, depth=3, row_share=0.8, feature_share=0.6, min_leaf=3
        )
        for i in range(3)
    ]
    found = models.oof_scores(specs, train, CONFIG)
    assert found.count() == 3 * train.count()
    ranked = metrics.ranking_metrics(found).collect()
    assert len(ranked) == 3 and all(r["auc"] > 0.7 for r in ranked)


def test_partitions_and_passes_have_no_say(train, monkeypatch):
    spec = models.boosting(COLUMNS, trees=3, depth=4, row_share=0.7, feature_share=0.6)
    others = [models.boosting(COLUMNS, f"o{i}", trees=2, depth=2) for i in range(2)]
    whole = by_id(models.oof_scores([spec], train, CONFIG, folds=2))
    monkeypatch.setattr(joint_boosting, "PASS_CELLS", 8)
    monkeypatch.setattr(joint_boosting, "NODES_PER_GROUP", 2)
    monkeypatch.setattr(joint_boosting, "PARTITION_ROWS", 150)
    cut = by_id(models.oof_scores([*others, spec], train.repartition(11), CONFIG, folds=2))
    assert len(whole) == train.where("fold < 2").count()
    assert all(cut[key] == pytest.approx(score, abs=1e-6) for key, score in whole.items())


def test_best_cut_of_a_node_by_hand():
    """Two codes of residual 1 and two of -1: the cut is between them, and leaves are means."""
    rows = np.zeros((1, 1, joint_boosting.CODES, 2), np.int64)
    rows[0, 0, :4, 0] = 3
    sums = np.zeros((1, 1, joint_boosting.CODES), np.int64)
    sums[0, 0, :4] = np.array([3, 3, -3, -3]) * joint_boosting.SCALE
    found = joint_boosting.best_cuts(rows, sums, (1.0, 1.0), 1, np.ones((1, 1), bool))
    assert [found[c][0] for c in ("feature", "cut", "n_left", "n")] == [0, 1, 6, 12]
    assert [found[c][0] for c in ("left", "right", "value")] == [1.0, -1.0, 0.0]
    few = joint_boosting.best_cuts(rows, sums, (1.0, 1.0), 7, np.ones((1, 1), bool))
    assert few["feature"][0] == -1


def test_rows_without_a_value_are_an_error(train):
    spec = models.boosting(COLUMNS, trees=2, depth=2)
    holed = train.withColumn("x1", F.when(F.col("x0") > 3, F.col("x1")))
    with pytest.raises(Exception, match="x1 has no value"):
        models.oof_scores([spec], holed, CONFIG).count()


def test_scores_equal_those_of_mllib_in_probability(train):
    """One tree of one level: the margin is the mean sign, the score its logistic."""
    spec = models.boosting(COLUMNS, trees=1, depth=1)
    got = by_id(models.oof_scores([spec], train, CONFIG, folds=1))
    model = models.fit(spec, train.where("fold <> 0"))
    own = model.transform(train.where("fold = 0")).select(
        models.ID, vector_to_array("probability")[1].alias("score")
    )
    for r in own.collect():
        assert got["boosting", r[models.ID]] == pytest.approx(r["score"], abs=1e-6)
