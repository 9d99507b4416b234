"""Inferential logistic regression: design matrix, coefficient table, block tests, VIF."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.functions.distributions import (
    NORMAL_975,
    chi_square_upper_p,
    normal_two_sided_p,
)
from secondcart.operators import irls
from secondcart.operators.caching import persisted
from secondcart.operators.describe import mode
from secondcart.operators.features import net_sentiment
from secondcart.operators.order_stats import exact_quantiles

NET_TEXT = "net"
SEPARATE_TEXT = "separate"
STATE_PREFIX = "state_"
MONTH_PREFIX = "month_"
MAX_LEVELS = 64


@dataclass(frozen=True)
class LinearSpec:
    """What a design matrix has to know beyond its rows."""

    clip_low: float
    clip_high: float
    reference_state: str
    states: tuple[str, ...]
    months: tuple[int, ...]

    def columns(self, text: str = NET_TEXT) -> list[str]:
        text_columns = (
            ["net_sentiment"] if text == NET_TEXT else ["has_text", "sent_neg", "sent_pos"]
        )
        return [
            "log_value",
            "slack_days",
            "late_flag",
            "durable",
            "rating",
            *text_columns,
            *[f"{STATE_PREFIX}{s}" for s in self.states if s != self.reference_state],
            *[f"{MONTH_PREFIX}{m}" for m in self.months[1:]],
        ]


def _levels(df: DataFrame, column: str) -> tuple:
    rows = df.select(column).distinct().orderBy(column).limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels: too many for dummies")
    return tuple(r[0] for r in rows)


def winsor_limits(train: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Clip limits of a column, from the training rows only."""
    q = F.col("quantiles")
    return exact_quantiles(train, column, [low, high]).select(
        q[0].alias("clip_low"), q[1].alias("clip_high")
    )


def linear_spec(rows: DataFrame, clip_low: float, clip_high: float) -> LinearSpec:
    """Clip limits from the training rows; reference state and dummy levels from all rows.

    ``rows`` has the imputed features, ``state_group`` and ``split``.
    """
    train = rows.where(F.col("split") == "train")
    limits = winsor_limits(train, "slack_days", clip_low, clip_high).first()
    return LinearSpec(
        limits["clip_low"],
        limits["clip_high"],
        mode(rows, "state_group").first()["state_group"],
        _levels(rows, "state_group"),
        _levels(rows, "purchase_month"),
    )


def design_matrix(
    rows: DataFrame, spec: LinearSpec, text: str = NET_TEXT, keep: Sequence[str] = ()
) -> DataFrame:
    """One double column per term. ``text`` chooses one net sentiment or three text columns
    (which are nearly collinear)."""
    terms = {
        "log_value": F.log1p("first_value"),
        "slack_days": F.least(
            F.greatest(F.col("slack_days"), F.lit(spec.clip_low)), F.lit(spec.clip_high)
        ),
        "net_sentiment": net_sentiment(),
    }
    for state in spec.states:
        terms[f"{STATE_PREFIX}{state}"] = F.col("state_group") == state
    for month in spec.months:
        terms[f"{MONTH_PREFIX}{month}"] = F.col("purchase_month") == month
    return rows.select(
        *keep,
        *[terms.get(c, F.col(c)).cast("double").alias(c) for c in spec.columns(text)],
    )


def _assembled(design: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(design)


def fit_logit(train: DataFrame, columns: Sequence[str], label: str = "target") -> irls.Fitted:
    """Unpenalised maximum likelihood by iteratively reweighted least squares."""
    return fit_logits(train, {"logit": columns}, label)[0]


def fit_logits(
    train: DataFrame, designs: Mapping[str, Sequence[str]], label: str = "target"
) -> list[irls.Fitted]:
    """The regression on each of several lists of columns, all in the same passes."""
    every = list(dict.fromkeys(c for columns in designs.values() for c in columns))
    fits = [irls.Fit(name, tuple(columns)) for name, columns in designs.items()]
    with persisted(train.select(label, *every)) as rows:
        return irls.fit_all(rows, fits, label)


def vif(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factor of each term: the diagonal of the inverse correlation matrix.

    The matrix is aggregated on the executors; only its few dozen rows are inverted here.
    """
    matrix = Correlation.corr(_assembled(train, columns).select("features"), "features")
    values = matrix.first()[0].toArray()
    factors = np.diag(np.linalg.inv(values))
    return train.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, factors, strict=True)], "term string, vif double"
    )


def _odds(log_odds: float) -> float:
    """Infinite beyond the largest double: a level without positives has no finite bound."""
    return math.exp(log_odds) if log_odds < 709.0 else math.inf


def logit_table(
    model: irls.Fitted, train: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Coefficient, odds ratio with 95% interval, p-value and VIF per term."""
    names = ["const", *columns]
    coefficients = [model.intercept, *map(float, model.coefficients)]
    errors = list(map(float, model.standard_errors))
    rows = [
        (
            name,
            b,
            _odds(b),
            _odds(b - NORMAL_975 * se),
            _odds(b + NORMAL_975 * se),
            float(b / se),
        )
        for name, b, se in zip(names, coefficients, errors, strict=True)
    ]
    table = train.sparkSession.createDataFrame(
        rows,
        "term string, coefficient double, odds_ratio double, or_ci_low double,"
        " or_ci_high double, z double",
    )
    table = table.withColumn("p_value", normal_two_sided_p("z")).drop("z")
    return table.join(vif(train, columns), "term", "left")


def fit_stats(model: irls.Fitted, train: DataFrame) -> DataFrame:
    """Log-likelihoods and McFadden's pseudo-R2 (for 0/1 labels the deviance is -2 ll)."""
    row = (
        -model.deviance / 2.0,
        -model.null_deviance / 2.0,
        1.0 - model.deviance / model.null_deviance,
    )
    return train.sparkSession.createDataFrame(
        [row], "log_likelihood double, null_log_likelihood double, pseudo_r2 double"
    )


def block_lr_test(
    model: irls.Fitted,
    train: DataFrame,
    columns: Sequence[str],
    blocks: Sequence[str] = (STATE_PREFIX, MONTH_PREFIX),
) -> DataFrame:
    """Likelihood-ratio test of each block of dummies (named by prefix) against leaving it out.
    All regressions that leave a block out are fitted together."""
    kept = {b: [c for c in columns if not c.startswith(b)] for b in blocks}
    rows = []
    for fitted in fit_logits(train, kept):
        df = len(columns) - len(fitted.fit.columns)
        statistic = float(fitted.deviance - model.deviance)
        rows.append((fitted.fit.name.rstrip("_"), df, statistic))
    table = train.sparkSession.createDataFrame(
        rows, "block string, degrees_of_freedom int, chi_square double"
    )
    p = chi_square_upper_p(F.col("chi_square"), F.col("degrees_of_freedom"))
    return table.withColumn("p_value", p)


def logit_scores(
    model: irls.Fitted,
    design: DataFrame,
    columns: Sequence[str],
    id_column: str = "customer_unique_id",
    label: str = "target",
) -> DataFrame:
    """Score table of the fitted regression."""
    return design.select(
        F.lit("logit").alias("model"),
        F.col(id_column),
        F.col(label).cast("int").alias("label"),
        model.probability().alias("score"),
    )
