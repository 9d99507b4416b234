"""Logistic inference against Newton steps and closed forms in NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from secondcart.functions.distributions import NORMAL_975
from secondcart.operators import inference, irls, models
from secondcart.operators.quality import QualityError, assert_golden
from tests.tails import chi_square_upper, normal_two_sided

COLUMNS = ["a", "b", "month_2", "month_3"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 3000
    month = rng.integers(1, 4, n)
    x = np.column_stack(
        [rng.normal(size=n), rng.normal(size=n), month == 2, month == 3]
    ).astype(float)
    x[:, 1] += 0.7 * x[:, 0]
    p = 1 / (1 + np.exp(1.5 - 0.8 * x[:, 0] + 0.4 * x[:, 2]))
    y = (rng.random(n) < p).astype(int)
    rows = [(str(i), int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))]
    schema = "customer_unique_id string, target int, a double, b double, month_2 double, month_3 double"
    return spark.createDataFrame(rows, schema).cache(), x, y


def newton(x, y, penalty=None, weights=None):
    z = np.column_stack([np.ones(len(x)), x])
    w0 = np.ones(len(y)) if weights is None else weights
    ridge = np.zeros(z.shape[1]) if penalty is None else np.r_[0, np.full(x.shape[1], penalty)]
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        h = (z * (w0 * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        b = b + np.linalg.solve(h, z.T @ (w0 * (y - p)) - ridge * b)
    p = 1 / (1 + np.exp(-z @ b))
    ll = np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    return b, np.sqrt(np.diag(np.linalg.inv(h))), ll


def test_table_matches_newton(data):
    df, x, y = data
    model = inference.fit_logit(df, COLUMNS)
    table = {r["term"]: r for r in inference.logit_table(model, df, COLUMNS).collect()}
    b, se, ll = newton(x, y)
    for i, term in enumerate(["const", *COLUMNS]):
        row = table[term]
        assert row["coefficient"] == pytest.approx(b[i], abs=1e-6)
        assert row["odds_ratio"] == pytest.approx(np.exp(b[i]), rel=1e-6)
        assert row["or_ci_low"] == pytest.approx(np.exp(b[i] - NORMAL_975 * se[i]), rel=1e-5)
        assert row["or_ci_high"] == pytest.approx(np.exp(b[i] + NORMAL_975 * se[i]), rel=1e-5)
        assert row["p_value"] == pytest.approx(normal_two_sided(b[i] / se[i]), rel=1e-3, abs=1e-12)
    assert table["const"]["vif"] is None
    assert table["a"]["p_value"] > 0  # far tail, no underflow
    stats = inference.fit_stats(model, df).first()
    share = y.mean()
    null = len(y) * (share * np.log(share) + (1 - share) * np.log(1 - share))
    assert stats["log_likelihood"] == pytest.approx(ll, abs=1e-6)
    assert stats["pseudo_r2"] == pytest.approx(1 - ll / null, abs=1e-9)


def test_many_fits_equal_mllib(data):
    """Column subsets and held-out rows in the same passes, each with MLlib's estimates."""
    df, _, _ = data
    folds = df.withColumn("fold", (F.col("customer_unique_id") % 3).cast("int"))
    fits = [irls.Fit("all", tuple(COLUMNS)), irls.Fit("some", ("a", "month_3"))]
    fitted = irls.fit_all(folds, irls.per_fold(fits, 3) + fits, "target", "fold")
    assert len(fitted) == 8
    for f in fitted:
        own = folds.where(F.col("fold") != f.fit.held_out) if f.fit.held_out >= 0 else folds
        rows = VectorAssembler(inputCols=list(f.fit.columns), outputCol="features").transform(own)
        plain = GeneralizedLinearRegression(
            family="binomial", link="logit", regParam=0.0, maxIter=100, tol=1e-12, labelCol="target"
        ).fit(rows)
        np.testing.assert_allclose(f.coefficients, plain.coefficients.toArray(), atol=1e-6)
        assert f.intercept == pytest.approx(plain.intercept, abs=1e-6)
        errors = plain.summary.coefficientStandardErrors
        np.testing.assert_allclose(f.standard_errors, [errors[-1], *errors[:-1]], rtol=1e-5)
        assert f.deviance == pytest.approx(plain.summary.deviance, abs=1e-6)
        assert f.null_deviance == pytest.approx(plain.summary.nullDeviance, abs=1e-6)


def test_a_level_without_positives_still_ends(spark):
    rows = [(float(k % 7), float(k % 5 == 0), int(k % 3 == 0 and k % 5 != 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "a double, month_2 double, target int")
    fitted = inference.fit_logit(df, ["a", "month_2"])
    assert fitted.coefficients[1] < -10 and np.isfinite(fitted.coefficients).all()
    assert fitted.steps < irls.MAX_STEPS


def test_vif_is_one_over_unexplained_share(data):
    df, x, _ = data
    got = {r["term"]: r["vif"] for r in inference.vif(df, COLUMNS).collect()}
    for j, term in enumerate(COLUMNS):
        others = np.column_stack([np.ones(len(x)), np.delete(x, j, axis=1)])
        fitted = others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        r2 = 1 - ((x[:, j] - fitted) ** 2).sum() / ((x[:, j] - x[:, j].mean()) ** 2).sum()
        assert got[term] == pytest.approx(1 / (1 - r2), rel=1e-8)


def test_block_test(data):
    df, x, y = data
    model = inference.fit_logit(df, COLUMNS)
    row = inference.block_lr_test(model, df, COLUMNS, ["month_"]).first()
    statistic = 2 * (newton(x, y)[2] - newton(x[:, :2], y)[2])
    assert row["degrees_of_freedom"] == 2
    assert row["chi_square"] == pytest.approx(statistic, abs=1e-6)
    assert row["p_value"] == pytest.approx(chi_square_upper(statistic, 2), rel=1e-6)


def test_scores(data):
    df, x, y = data
    model = inference.fit_logit(df, COLUMNS)
    scores = inference.logit_scores(model, df, COLUMNS).collect()
    b, _, _ = newton(x, y)
    p = 1 / (1 + np.exp(-np.column_stack([np.ones(len(x)), x]) @ b))
    got = np.array([r["score"] for r in sorted(scores, key=lambda r: int(r["customer_unique_id"]))])
    np.testing.assert_allclose(got, p, atol=1e-7)


def test_balanced_ridge_logistic_is_the_penalised_optimum(data):
    df, x, y = data
    spec = models.logistic(COLUMNS)
    scored = models.score(spec, models.fit(spec, df), df).collect()
    scaled = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, _, _ = newton(scaled, y, penalty=1.0, weights=weights)
    p = 1 / (1 + np.exp(-np.column_stack([np.ones(len(x)), scaled]) @ b))
    got = np.array([r["score"] for r in sorted(scored, key=lambda r: int(r["customer_unique_id"]))])
    np.testing.assert_allclose(got, p, atol=1e-5)


def test_golden_gate(spark):
    actual = spark.createDataFrame([("x", 1.0004), ("y", 2.0)], "term string, coefficient double")
    good = spark.createDataFrame([("x", 1.0)], "term string, coefficient double")
    assert_golden(actual, good, "term", "coefficient", 0.0006)
    bad = spark.createDataFrame([("x", 1.0), ("z", 0.0)], "term string, coefficient double")
    with pytest.raises(QualityError, match="z"):
        assert_golden(actual, bad, "term", "coefficient", 0.0006)


def test_design_matrix_levels_and_clipping(spark):
    rows = [
        ("p1", 0, "train", 0.0, -50.0, 1, 0, 5.0, 1, 0.2, 0.9, "SP", 2),
        ("p2", 1, "train", 9.0, 3.0, 0, 1, 1.0, 0, 0.0, 0.0, "SP", 3),
        ("p3", 0, "test", 9.0, 900.0, 0, 1, 1.0, 0, 0.0, 0.0, "RJ", 5),
    ]
    df = spark.createDataFrame(
        rows,
        "customer_unique_id string, target int, split string, first_value double,"
        " slack_days double, late_flag int, durable int, rating double, has_text int,"
        " sent_neg double, sent_pos double, state_group string, purchase_month int",
    )
    spec = inference.linear_spec(df, 0.01, 0.99)
    # Limits come from the training rows, levels and reference from all rows.
    assert spec.clip_low == pytest.approx(-50 + 0.01 * 53)
    assert spec.reference_state == "SP" and spec.months == (2, 3, 5)
    assert spec.columns()[-3:] == ["state_RJ", "month_3", "month_5"]
    got = {r["customer_unique_id"]: r for r in
           inference.design_matrix(df, spec, keep=("customer_unique_id",)).collect()}
    assert got["p3"]["slack_days"] == pytest.approx(-50 + 0.99 * 53)
    assert got["p1"]["net_sentiment"] == pytest.approx(0.7)
    assert got["p3"]["state_RJ"] == 1.0 and got["p1"]["state_RJ"] == 0.0
    assert got["p2"]["log_value"] == pytest.approx(np.log(10))
    separate = spec.columns(inference.SEPARATE_TEXT)
    assert "net_sentiment" not in separate and {"has_text", "sent_neg", "sent_pos"} <= set(separate)
