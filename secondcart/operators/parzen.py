"""Proposals of a sequential search by tree-structured Parzen estimators.

Trials with the best scores and all others each give a density per parameter: a mixture of normals cut
to the range, one around every value seen and one, the prior, over the whole range. Candidates are drawn
from the density of the best, and the one whose density is most above that of the others is tried next.
Parameters are independent. Whole numbers have the mass of half a step to either side.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

# Trials drawn at random before the first proposal.
STARTUP = 10
CANDIDATES = 24
# Share and greatest number of trials that count as the best.
BEST_SHARE, MOST_BEST = 0.1, 25
# Trials that weigh alike; of more, the earlier ones weigh less.
ALIKE = 25

_STANDARD = NormalDist()
_phi = np.vectorize(_STANDARD.cdf, otypes=[float])


@dataclass(frozen=True)
class Scale:
    """A range as the estimators see it: logarithms where it is logarithmic, and half a step more at
    both ends of whole numbers."""

    low: float
    high: float
    log: bool
    integer: bool

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    @property
    def ends(self) -> tuple[float, float]:
        half = 0.5 if self.integer else 0.0
        return self.inner(self.low - half), self.inner(self.high + half)

    def outer(self, x: float) -> float:
        value = math.exp(x) if self.log else x
        if self.integer:
            value = round(value)
        value = min(self.high, max(self.low, value))
        return int(value) if self.integer else value


def weights_by_age(n: int) -> np.ndarray:
    """Weight of each trial, the earliest first."""
    if n < ALIKE:
        return np.ones(n)
    return np.concatenate([np.linspace(1.0 / n, 1.0, n - ALIKE), np.ones(ALIKE)])


class Mixture:
    """Density of a parameter in the trials whose values are given, the earliest first."""

    def __init__(self, values: Sequence[float], scale: Scale):
        self.scale = scale
        self.low, self.high = scale.ends
        width = self.high - self.low
        means = np.array([*[scale.inner(v) for v in values], (self.low + self.high) / 2])
        order = means.argsort(kind="stable")
        around = np.concatenate([[self.low], means[order], [self.high]])
        gaps = np.maximum(around[1:-1] - around[:-2], around[2:] - around[1:-1])
        if len(around) >= 4:
            gaps[0], gaps[-1] = around[2] - around[1], around[-2] - around[-3]
        spread = np.empty(len(means))
        spread[order] = gaps
        spread = np.clip(spread, width / min(100.0, 1.0 + len(means)), width)
        spread[-1] = width
        self.means, self.spread = means, spread
        weights = np.append(weights_by_age(len(values)), 1.0)
        self.weights = weights / weights.sum()
        self.below = _phi((self.low - means) / spread)
        self.inside = _phi((self.high - means) / spread) - self.below

    def draw(self, rng: random.Random) -> float:
        k = rng.choices(range(len(self.means)), self.weights)[0]
        share = self.below[k] + rng.random() * self.inside[k]
        z = _STANDARD.inv_cdf(min(1 - 1e-12, max(1e-12, share)))
        x = min(self.high, max(self.low, self.means[k] + self.spread[k] * z))
        return self.scale.outer(x)

    def log_density(self, value: float) -> float:
        if self.scale.integer:
            start, end = (
                min(self.high, max(self.low, self.scale.inner(value + side)))
                for side in (-0.5, 0.5)
            )
            mass = _phi((end - self.means) / self.spread) - _phi((start - self.means) / self.spread)
        else:
            z = (self.scale.inner(value) - self.means) / self.spread
            mass = np.exp(-z * z / 2) / (self.spread * math.sqrt(2 * math.pi))
        return math.log(max(float((self.weights * mass / self.inside).sum()), 1e-300))


def proposed(
    scales: dict[str, Scale], trials: Sequence[dict], scores: Sequence[float], rng: random.Random
) -> dict:
    """The next trial, from all earlier ones and their scores, of which more is better."""
    n_best = min(math.ceil(BEST_SHARE * len(trials)), MOST_BEST)
    ranked = sorted(range(len(trials)), key=lambda k: (-scores[k], k))
    best, others = sorted(ranked[:n_best]), sorted(ranked[n_best:])
    found = {}
    for name, scale in scales.items():
        good = Mixture([trials[k][name] for k in best], scale)
        bad = Mixture([trials[k][name] for k in others], scale)
        candidates = [good.draw(rng) for _ in range(CANDIDATES)]
        found[name] = max(candidates, key=lambda v: good.log_density(v) - bad.log_density(v))
    return found
