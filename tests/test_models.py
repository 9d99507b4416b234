"""Cross-validation, search, ablation and attributions on a small learnable table."""

from __future__ import annotations

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.hashing import hash32
from secondcart.operators import explain, irls, metrics, models, sampling

COLUMNS = ["x0", "x1", "x2", "x3"]
CONFIG = replace(Config().quick(), cv_folds=3, search_trials=2, bootstrap_replicates=20)


@pytest.fixture(scope="module")
def rows(spark):
    noise = hash32(1, "noise", "customer_unique_id") / F.lit(2.0**32)
    df = spark.range(900).select(F.col("id").cast("string").alias("customer_unique_id")).select(
        "customer_unique_id",
        *[(hash32(1, c, "customer_unique_id") % 97 / F.lit(97.0)).alias(c) for c in COLUMNS[:3]],
        (hash32(1, "x3", "customer_unique_id") % 3).cast("double").alias("x3"),
        noise.alias("noise"),
    )
    df = df.withColumn(
        "target", (F.col("x0") + F.col("x1") * F.col("x3") + F.col("noise") > 1.9).cast("int")
    ).drop("noise")
    split = sampling.stratified_split(df, "customer_unique_id", "target", 0.2, 42)
    train = sampling.stratified_folds(
        split.where("split = 'train'"), "customer_unique_id", "target", 3, 42
    )
    test = split.where("split = 'test'").withColumn("fold", F.lit(None).cast("int"))
    return train.unionByName(test).cache()


@pytest.fixture(scope="module")
def train(rows):
    return rows.where("split = 'train'")


def test_class_weights_sum_to_the_rows(train):
    row = models.class_weights(train).first()
    n, k = row["n_train"], row["n_positive"]
    assert row["weight_negative"] * (n - k) + row["weight_positive"] * k == pytest.approx(n)
    assert row["positive_ratio"] == pytest.approx((n - k) / k)


def test_one_class_is_an_error(train):
    spec = models.logistic(COLUMNS)
    with pytest.raises(ValueError, match="both classes"):
        models.fit(spec, train.where("target = 0"))


def test_oof_scores_each_row_once(train):
    specs = [models.logistic(COLUMNS), models.forest(COLUMNS, trees=3, depth=4)]
    oof = models.oof_scores(specs, train, CONFIG)
    assert oof.count() == 2 * train.count()
    assert oof.select("model", "customer_unique_id").distinct().count() == oof.count()
    by_fold = models.cv_average_precision(oof)
    assert by_fold.count() == 6
    assert by_fold.where("ap > 0 and ap <= 1").count() == 6


def test_search_is_seeded_and_in_range(train):
    space = models.SEARCH_SPACES[0]
    assert models.draw_trials(space, CONFIG) == models.draw_trials(space, CONFIG)
    for trial in models.draw_trials(space, replace(CONFIG, search_trials=50)):
        assert 4 <= trial["depth"] <= 20 and 1 <= trial["min_leaf"] <= 40
        assert 0.3 <= trial["feature_share"] <= 1.0
    result = models.search(space, train, COLUMNS, CONFIG)
    assert len(result.trials) == 2
    assert result.best == max(result.trials, key=lambda t: t.mean_ap).drawn
    table = models.hp_table([result], train)
    assert table.count() == 4
    leaf = table.where("hyperparameter = 'min_leaf'").first()
    assert (leaf["low"], leaf["high"], leaf["log_scale"]) == (1.0, 40.0, True)


def test_search_metric_is_the_mean_fold_ap(train):
    """The number of a trial equals the mean over folds of fits made one by one."""
    space = models.SEARCH_SPACES[0]
    result = models.search(space, train, COLUMNS, CONFIG)
    trial, mean_ap = result.trials[0].drawn, result.trials[0].mean_ap
    spec = space.make(COLUMNS, "again", **trial, seed=CONFIG.seed)
    values = []
    for k in range(3):
        model = models.fit(spec, train.where(F.col("fold") != k))
        scored = models.score(spec, model, train.where(F.col("fold") == k))
        values.append(metrics.average_precision(scored).first()["ap"])
    assert mean_ap == pytest.approx(np.mean(values), abs=1e-9)


def test_halving_keeps_the_best_trial(train, monkeypatch):
    """The survivor of the rungs is the best of the trials when all of them are run in full."""
    config = replace(CONFIG, search_trials=9)

    def make(columns, name, k, seed):
        return models.logistic(columns[:k], name)

    space = models.SearchSpace("columns", {"k": models.Range(1, 4, integer=True)}, make)
    halved = models.search(space, train, COLUMNS, config)
    assert sorted(t.rung for t in halved.trials) == [0] * 6 + [1] * 2 + [2]
    full = models.search(space, train, COLUMNS, config, [models.Rung(3, 1.0, 1.0)])
    assert all(t.rung == 0 for t in full.trials)
    assert len({t.drawn["k"] for t in full.trials}) > 2
    assert halved.best == full.best
    table = models.search_table([halved], train)
    assert table.where("rung = 2").count() == 1 and table.count() == 9
    # A driver that starts again reads the rungs and fits nothing.
    monkeypatch.setattr(models, "oof_scores", None)
    again = models.search(space, train, COLUMNS, config)
    assert again.trials == halved.trials


def test_rungs_share_out_folds_and_trees():
    space = models.SEARCH_SPACES[0]
    steps = models.rungs(Config())
    assert [(r.folds, r.tree_share) for r in steps] == [(1, 0.25), (2, 0.5), (5, 1.0)]
    drawn = {"trees": 400, "depth": 9, "min_leaf": 3, "feature_share": 0.5}
    assert models._on_rung(space, drawn, steps[0]) == drawn | {"trees": 100}


def test_a_half_written_rung_is_measured_again(train, spark):
    folder = models.RungTables(train, "half")
    rows = spark.createDataFrame([(0, 0.5)], "trial int, mean_ap double")
    rows.write.mode("overwrite").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{folder.path}/rung-0")
    better = rows.withColumn("mean_ap", F.lit(0.75))
    assert folder.rung(0, lambda: better) == {0: 0.75}
    assert models.RungTables(train, "half").rung(0, None) == {0: 0.75}
    assert models.RungTables(train.where("x0 > 0"), "half").path != folder.path


def test_logistic_folds_and_variants_equal_single_fits(train, rows):
    """One job per step for all of them, and MLlib's coefficients for each."""
    specs = [models.logistic(COLUMNS), models.logistic(COLUMNS[1:], "fewer")]
    oof = models.oof_scores(specs, train, CONFIG)
    got = {(r["model"], r[models.ID]): r["score"] for r in oof.collect()}
    assert len(got) == 2 * train.count()
    for spec in specs:
        for k in range(3):
            model = models.fit(spec, train.where(F.col("fold") != k))
            alone = models.score(spec, model, train.where(F.col("fold") == k)).collect()
            assert max(abs(r["score"] - got[spec.name, r[models.ID]]) for r in alone) < 1e-6
    (fitted,) = irls.fit_all(train, [specs[0].linear()], models.LABEL)
    scaler, regression = models.fit(specs[0], train).stages[1].stages
    raw = regression.coefficients.toArray() / scaler.std.toArray()
    np.testing.assert_allclose(fitted.coefficients, raw, rtol=1e-6, atol=1e-6)
    intercept = regression.intercept - (raw * scaler.mean.toArray()).sum()
    assert fitted.intercept == pytest.approx(intercept, abs=1e-6)
    assert fitted.steps < 20


def test_one_live_model_per_worker_thread(train, monkeypatch):
    """Every fit is written and let go before the next starts on its thread."""
    import gc
    import weakref

    made, most = [], [0]
    plain = models.score

    def watched(spec, model, rows):
        made.append(weakref.ref(model))
        gc.collect()
        most[0] = max(most[0], sum(r() is not None for r in made))
        return plain(spec, model, rows)

    monkeypatch.setattr(models, "score", watched)
    # Logistic regressions are fitted together; trees are what threads fit one by one.
    specs = [models.forest(COLUMNS, f"m{i}", trees=2, depth=2) for i in range(4)]
    oof = models.oof_scores(specs, train, replace(CONFIG, parallelism=2))
    assert len(made) == 12 and most[0] <= 3
    assert oof.select("model").distinct().count() == 4


def test_class_counts_give_the_weights_of_every_fold(train):
    counts = models.counts_by_fold(train)
    rest = models.sum_counts(counts.values()) - counts[0]
    row = models.class_weights(train.where("fold <> 0")).first()
    assert (rest.rows, rest.positive) == (row["n_train"], row["n_positive"])
    assert models.class_counts(train) == models.sum_counts(counts.values())
    with pytest.raises(ValueError):
        models.ClassCounts(5, 0).weight(models.BALANCED)


def test_metrics_table_and_finalist(rows, train):
    specs = [models.logistic(COLUMNS), models.boosting(COLUMNS, trees=3, depth=3)]
    oof = models.oof_scores(specs, train, CONFIG)
    test = models.test_scores(specs, rows, CONFIG)
    table = models.metrics_table(oof, test, CONFIG)
    assert len(table.columns) == 12
    found = {r["model"]: r for r in table.collect()}
    assert set(found) == {"logistic", "boosting"}
    assert all(0.5 < r["auc"] <= 1 for r in found.values())
    cv = metrics.average_precision(oof).withColumnRenamed("ap", "cv_ap")
    best = max(found.values(), key=lambda r: r["cv_ap"])["model"]
    assert models.finalist(cv).first()["model"] == best


def test_ablation_summary(spark):
    folds = spark.createDataFrame(
        [("full model", 0, 0.4), ("full model", 1, 0.6), ("without x", 0, 0.3), ("without x", 1, 0.3)],
        "model string, fold int, ap double",
    )
    got = {r["variant"]: r for r in models.ablation_summary(folds).collect()}
    assert got["full model"]["sd_over_folds"] == pytest.approx(np.std([0.4, 0.6], ddof=1))
    assert got["full model"]["difference"] == 0.0
    assert got["without x"]["difference"] == pytest.approx(-0.2)


def test_ablation_variants():
    from secondcart.functions.lookups import TREE_FEATURES

    variants = models.ablation_variants(list(TREE_FEATURES))
    assert len(variants) == 9
    assert variants["without delivery"] == [
        c for c in TREE_FEATURES if c not in ("slack_days", "late_flag")
    ]
    assert len(variants["without review (rating and text)"]) == 6


def brute_shapley(table, x):
    """Shapley values by summing over all feature subsets."""
    n = len(x)

    def value(known):
        total = 0.0
        for features, low, high, share, leaf in table.values():
            for i in range(len(leaf)):
                factor = leaf[i]
                for j, f in enumerate(features[i]):
                    if f in known:
                        factor *= float(low[i, j] < x[f] <= high[i, j])
                    else:
                        factor *= share[i, j]
                total += factor
        return total

    phi = np.zeros(n)
    for i in range(n):
        rest = [f for f in range(n) if f != i]
        for size in range(n):
            for subset in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                phi[i] += w * (value({*subset, i}) - value(set(subset)))
    return phi


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_attributions_are_shapley_values(spark, train, kind):
    if kind == "forest":
        spec = models.forest(COLUMNS, trees=4, depth=6)
    else:
        spec = models.boosting(COLUMNS, trees=4, depth=5)
    model = models.fit(spec, train)
    table = explain.leaf_table(model.stages[-1], spark)
    sample = train.orderBy("customer_unique_id").limit(40)
    x = np.array([[r[c] for c in COLUMNS] for r in sample.select(*COLUMNS).collect()])
    phi = explain.attributions(table, x)
    for row in range(4):
        np.testing.assert_allclose(phi[row], brute_shapley(table, x[row]), atol=1e-10)

    # Attributions and the expected value add up to the prediction.
    p = np.array([r[0] for r in model.transform(sample).select(vector_to_array("probability")[1]).collect()])
    total = explain.expected_value(table) + phi.sum(axis=1)
    expected = p if kind == "forest" else np.log(p / (1 - p))
    np.testing.assert_allclose(total, expected, atol=1e-9)

    # The distributed job gives the same numbers.
    long = explain.tree_shap(model, sample.repartition(3), COLUMNS, "customer_unique_id")
    got = {(r["customer_unique_id"], r["feature"]): r["phi"] for r in long.collect()}
    ids = [r[0] for r in sample.select("customer_unique_id").collect()]
    for i, key in enumerate(ids):
        for j, name in enumerate(COLUMNS):
            assert got[(key, name)] == pytest.approx(phi[i, j], abs=1e-12)


def test_importance_blanks_meaningless_signs(spark):
    rows = [("p", f, float(v), s * v) for f, s in (("rating", 2.0), ("state_code", 1.0)) for v in range(5)]
    shap = spark.createDataFrame(rows, "id string, feature string, value double, phi double")
    got = {r["feature"]: r for r in explain.shap_importance(shap, "log-odds").collect()}
    assert got["rating"]["mean_abs_shap"] == 4.0
    assert got["rating"]["unit"] == "log-odds"
    assert got["rating"]["value_shap_correlation"] == pytest.approx(1.0)
    assert got["state_code"]["value_shap_correlation"] is None
    assert got["rating"]["readable_name"] == "Review rating"
