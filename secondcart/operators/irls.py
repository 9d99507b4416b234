"""Many logistic regressions in one job per step.

Fits differ in their columns, in the fold they leave out, in class weights and in penalty; all of
them read the same rows. Every step is one pass: each task adds up, for every fit, the weighted
Gram matrix, the gradient and the loss of its rows, and one vector per fit and task is shuffled and
summed. The driver holds a few dozen numbers squared per fit and solves for the next coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 300
# A step that lowers the loss by less than this share is the last.
TOLERANCE = 1e-12
# Rows whose matrices are made together.
BLOCK = 4096
NO_FOLD = -1


@dataclass(frozen=True)
class Fit:
    """One regression: its columns, the fold it leaves out, class weights, and a ridge penalty on
    the coefficients of standardised columns (0: plain maximum likelihood)."""

    name: str
    columns: tuple[str, ...]
    held_out: int = NO_FOLD
    balanced: bool = False
    penalty: float = 0.0


@dataclass(frozen=True)
class Fitted:
    """Coefficients of a fit with its covariance and loss; ``deviance`` is twice the loss."""

    fit: Fit
    intercept: float
    coefficients: np.ndarray
    covariance: np.ndarray
    deviance: float
    null_deviance: float
    steps: int

    @property
    def standard_errors(self) -> np.ndarray:
        """Of the intercept and then of the columns."""
        return np.sqrt(np.diag(self.covariance))

    def linear(self) -> Column:
        terms = zip(self.fit.columns, self.coefficients, strict=True)
        total = F.lit(float(self.intercept))
        for name, b in terms:
            if b:
                total = total + F.col(name) * float(b)
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.linear()))


def _arrow_blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
            yield part.column("y").to_numpy(), part.column("fold").to_numpy(), x


def _rows(df: DataFrame, columns: Sequence[str], label: str, fold: str | None) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") for c in columns])
    own = F.lit(NO_FOLD) if fold is None else F.coalesce(F.col(fold), F.lit(NO_FOLD))
    return df.select(
        F.col(label).cast("double").alias("y"), own.cast("int").alias("fold"), x.alias("x")
    )


def _summed(parts: DataFrame, key: Sequence[str]) -> list:
    """Vectors added up by key, in the tasks first."""
    vectors = parts.withColumn("v", array_to_vector("v"))
    summed = vectors.groupBy(*key).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))
    return summed.collect()


def moments(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Of every fold and class: rows, sums and sums of squares, in one vector. A training set's
    are the total less those of its fold."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for y, fold, x in _arrow_blocks(batches):
            for k in np.unique(fold):
                for c in (0, 1):
                    own = x[(fold == k) & (y == c)]
                    v = np.concatenate([[len(own)], own.sum(axis=0), (own * own).sum(axis=0)])
                    totals[int(k), c] = totals.get((int(k), c), 0) + v
        keys = list(totals)
        yield pa.RecordBatch.from_pydict(
            {
                "fold": pa.array([k for k, _ in keys], pa.int32()),
                "class": pa.array([c for _, c in keys], pa.int32()),
                "v": pa.array([totals[k].tolist() for k in keys], pa.list_(pa.float64())),
            }
        )

    parts = rows.mapInArrow(run, "fold int, class int, v array<double>")
    return {(r["fold"], r["class"]): np.array(r["v"]) for r in _summed(parts, ["fold", "class"])}


@dataclass
class _State:
    """A fit under way. ``use`` says which of all columns are its own; ``ridge`` is the penalty of
    each own coefficient and of the intercept, which has none."""

    fit: Fit
    use: np.ndarray
    weights: tuple[float, float]
    ridge: np.ndarray
    null_loss: float
    beta: np.ndarray
    step: np.ndarray
    loss: float = np.inf
    covariance: np.ndarray | None = None
    steps: int = 0
    done: bool = False


def _start(fit: Fit, columns: Sequence[str], found: dict[tuple[int, int], np.ndarray]) -> _State:
    p = len(columns)
    by_class = [
        sum((v for (k, own), v in found.items() if own == c and (k != fit.held_out or k == NO_FOLD)),
            np.zeros(2 * p + 1))
        for c in (0, 1)
    ]
    n = np.array([by_class[0][0], by_class[1][0]])
    if not n.all():
        raise ValueError("a training set needs both classes")
    total = by_class[0] + by_class[1]
    mean = total[1 : p + 1] / total[0]
    # The sample variance, by which standardised coefficients are penalised.
    variance = (total[p + 1 :] - total[0] * mean * mean) / max(total[0] - 1, 1)
    at = {c: i for i, c in enumerate(columns)}
    use = np.array([0, *[1 + at[c] for c in fit.columns]])
    ridge = np.concatenate([[0.0], fit.penalty * np.maximum(variance, 0)[use[1:] - 1]])
    weights = tuple(total[0] / (2 * n)) if fit.balanced else (1.0, 1.0)
    w = n * weights
    share = w / w.sum()
    beta = np.zeros(len(use))
    beta[0] = np.log(share[1] / share[0])
    return _State(
        fit, use, weights, ridge, float(-(w * np.log(share)).sum()), beta, np.zeros(len(use))
    )


def _pass(rows: DataFrame, states: list[_State]) -> dict[int, np.ndarray]:
    """Gram matrix, gradient and loss of every fit at its present coefficients."""
    wanted = [
        (k, s.fit.held_out, s.use, s.beta, s.weights) for k, s in enumerate(states) if not s.done
    ]

    def run(batches) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(use) ** 2 + len(use) + 1) for k, _, use, _, _ in wanted}
        for y, fold, x in _arrow_blocks(batches):
            z = np.column_stack([np.ones(len(x)), x])
            for k, held_out, use, beta, (low, high) in wanted:
                mine = slice(None) if held_out == NO_FOLD else fold != held_out
                own, label = z[mine][:, use], y[mine]
                eta = own @ beta
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                weight = np.where(label == 1, high, low)
                gram = (own * (weight * mu * (1 - mu))[:, None]).T @ own
                gradient = own.T @ (weight * (label - mu))
                loss = (weight * (np.logaddexp(0, eta) - label * eta)).sum()
                totals[k] += np.concatenate([gram.ravel(), gradient, [loss]])
        yield pa.RecordBatch.from_pydict(
            {
                "fit": pa.array(list(totals), pa.int32()),
                "v": pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64())),
            }
        )

    parts = rows.mapInArrow(run, "fit int, v array<double>")
    return {r["fit"]: np.array(r["v"]) for r in _summed(parts, ["fit"])}


def _advance(s: _State, v: np.ndarray) -> None:
    """One Newton step; a step that made the loss larger is halved instead."""
    p = len(s.use)
    gram, gradient, loss = v[: p * p].reshape(p, p), v[p * p : -1], float(v[-1])
    penalised = loss + 0.5 * float((s.ridge * s.beta * s.beta).sum())
    if penalised > s.loss * (1 + 1e-12) + 1e-300 and np.abs(s.step).max(initial=0) > 1e-12:
        s.step = s.step / 2
        s.beta = s.beta - s.step
        return
    gained = s.loss - penalised
    s.loss, s.steps = penalised, s.steps + 1
    curvature = gram + np.diag(s.ridge)
    try:
        s.covariance = np.linalg.inv(curvature)
    except np.linalg.LinAlgError:
        s.covariance = np.linalg.pinv(curvature)
    s.step = s.covariance @ (gradient - s.ridge * s.beta)
    if gained <= TOLERANCE * max(abs(penalised), 1e-300) or s.steps >= MAX_STEPS:
        s.done = True
        return
    s.beta = s.beta + s.step


def fit_all(
    df: DataFrame, fits: Sequence[Fit], label: str = "target", fold: str | None = None
) -> list[Fitted]:
    """All fits over the rows of ``df``, a job per step for all that have not converged.

    ``fold`` names the column that ``held_out`` refers to. The table is read once per step, so
    keep it in memory or written narrow. A level without positives drives its coefficient towards
    minus infinity; such a fit stops when its loss does not change any more.
    """
    columns = list(dict.fromkeys(c for f in fits for c in f.columns))
    rows = _rows(df, columns, label, fold)
    found = moments(rows)
    states = [_start(f, columns, found) for f in fits]
    while not all(s.done for s in states):
        for k, v in _pass(rows, states).items():
            _advance(states[k], v)
    return [
        Fitted(
            s.fit,
            float(s.beta[0]),
            s.beta[1:],
            s.covariance,
            2 * (s.loss - 0.5 * float((s.ridge * s.beta * s.beta).sum())),
            2 * s.null_loss,
            s.steps,
        )
        for s in states
    ]


def per_fold(fits: Sequence[Fit], folds: int) -> list[Fit]:
    """Every fit once per fold that it leaves out."""
    return [replace(f, held_out=k) for f in fits for k in range(folds)]


def scored(df: DataFrame, fitted: Sequence[Fitted], keep: Sequence[Column], fold: str | None):
    """``model``, the kept columns and ``score`` of every row by every fit that left its fold out
    (all fits where ``fold`` is not given)."""
    by_model: dict[str, list[Fitted]] = {}
    for f in fitted:
        by_model.setdefault(f.fit.name, []).append(f)
    entries = []
    for name, own in by_model.items():
        if fold is None:
            score = own[0].probability()
        else:
            score = F.lit(None).cast("double")
            for f in own:
                score = F.when(F.col(fold) == f.fit.held_out, f.probability()).otherwise(score)
        entries.append(F.struct(F.lit(name).alias("model"), score.alias("score")))
    return df.select(*keep, F.inline(F.array(*entries)))
