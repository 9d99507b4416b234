"""Classifiers: fitting, cross-validated scores, hyper-parameter search, evaluation, ablation.

All fits read a table that already has ``split`` and ``fold`` columns. Logistic regressions, of all
folds and column sets, are fitted together, one job per step. Trees are grown whole in tasks, a task
for a fit or for some trees of a forest; those of tables with more rows than a task takes grow together,
a pass for each level. Other estimators are MLlib jobs that the driver starts, several at a time.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.lookups import FEATURE_BLOCKS, JOINT_BLOCKS
from secondcart.operators import deep_forest, irls, joint_boosting, parzen, task_fits
from secondcart.operators.metrics import (
    average_precision,
    bootstrap_ci,
    bootstrap_metrics,
    f1_threshold,
    lift_top,
    ranking_metrics,
    threshold_metrics,
)
from secondcart.sources.writers import PartTables, is_written, shared_folder

ID = "customer_unique_id"
LABEL = "target"
WEIGHT = "weight"
BALANCED = "balanced"
POSITIVE_RATIO = "positive ratio"
# The deepest trees that MLlib grows.
MAX_DEPTH = 30


def run_parallel(jobs: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Start independent Spark jobs from a few driver threads."""
    if not jobs:
        return []
    pool = ThreadPool(min(parallelism, len(jobs)))
    inherits_session = inheritable_thread_target(SparkSession.active())
    try:
        return pool.map(lambda job: job(), [inherits_session(job) for job in jobs])
    finally:
        pool.close()


@dataclass(frozen=True)
class ModelSpec:
    """A named classifier over a list of columns. One with a ``penalty`` is a logistic regression
    and can be fitted together with others. The scores of those with ``deep`` or ``boosted`` come
    from trees that are grown in the tasks; their ``build`` is for single fits of few rows. A forest
    that is ``bagged`` can be made one with ``deep``."""

    name: str
    columns: tuple[str, ...]
    build: Callable[[int], Estimator]
    weighting: str
    penalty: float | None = None
    deep: deep_forest.DeepForest | None = None
    boosted: joint_boosting.Boosting | None = None
    bagged: deep_forest.DeepForest | None = None

    @property
    def ensemble(self) -> joint_boosting.Boosting | deep_forest.DeepForest | None:
        """What is grown in tasks."""
        return self.deep or self.boosted

    def grown_in_tasks(self) -> "ModelSpec":
        return replace(self, deep=self.deep or self.bagged)

    def with_columns(self, name: str, columns: Sequence[str]) -> "ModelSpec":
        return replace(self, name=name, columns=tuple(columns))

    def linear(self) -> irls.Fit:
        return irls.Fit(
            self.name, self.columns, balanced=self.weighting == BALANCED, penalty=self.penalty
        )


def class_weights(train: DataFrame) -> DataFrame:
    """Weight of each class when balanced, and negatives per positive."""
    positives, n = F.sum(LABEL), F.count("*")
    return train.agg(
        n.alias("n_train"),
        positives.cast("bigint").alias("n_positive"),
        F.try_divide(n, 2 * (n - positives)).alias("weight_negative"),
        F.try_divide(n, 2 * positives).alias("weight_positive"),
        F.try_divide(n - positives, positives).alias("positive_ratio"),
    )


@dataclass(frozen=True)
class ClassCounts:
    negative: int
    positive: int

    def __sub__(self, other: "ClassCounts") -> "ClassCounts":
        return ClassCounts(self.negative - other.negative, self.positive - other.positive)

    @property
    def rows(self) -> int:
        return self.negative + self.positive

    def weights(self, weighting: str) -> tuple[float, float]:
        """Weight of a negative and of a positive row."""
        if not self.negative or not self.positive:
            raise ValueError("a training set needs both classes")
        if weighting == BALANCED:
            return self.rows / (2 * self.negative), self.rows / (2 * self.positive)
        return 1.0, self.negative / self.positive

    def weight(self, weighting: str) -> Column:
        low, high = self.weights(weighting)
        return F.when(F.col(LABEL) == 1, high).otherwise(low)


def class_counts(rows: DataFrame) -> ClassCounts:
    return sum_counts(counts_by_fold(rows.withColumn("fold", F.lit(0))).values())


def counts_by_fold(rows: DataFrame) -> dict[int, ClassCounts]:
    """Both classes' rows in every fold, in one pass for all fits."""
    found = rows.groupBy("fold").agg(
        F.count_if(F.col(LABEL) != 1).alias("negative"),
        F.count_if(F.col(LABEL) == 1).alias("positive"),
    )
    return {r["fold"]: ClassCounts(r["negative"], r["positive"]) for r in found.collect()}


def sum_counts(counts: Iterable[ClassCounts]) -> ClassCounts:
    counts = list(counts)
    return ClassCounts(sum(c.negative for c in counts), sum(c.positive for c in counts))


def fit(spec: ModelSpec, train: DataFrame, counts: ClassCounts | None = None) -> PipelineModel:
    """Fit a model; ``counts`` are the training rows per class, if they are known already."""
    counts = class_counts(train) if counts is None else counts
    weighted = train.withColumn(WEIGHT, counts.weight(spec.weighting))
    assembler = VectorAssembler(inputCols=list(spec.columns), outputCol="features")
    return Pipeline(stages=[assembler, spec.build(counts.rows)]).fit(weighted)


def score(spec: ModelSpec, model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Score table ``(model, id, label, score[, fold])`` of a fitted model."""
    fold = [c for c in ("fold",) if c in rows.columns]
    return model.transform(rows).select(
        F.lit(spec.name).alias("model"),
        F.col(ID),
        F.col(LABEL).cast("int").alias("label"),
        vector_to_array("probability")[1].alias("score"),
        *fold,
    )


def logistic(columns: Sequence[str], name: str = "logistic") -> ModelSpec:
    """Standardised logistic regression with a unit-strength ridge penalty, balanced classes."""

    def build(n: int) -> Estimator:
        scaler = StandardScaler(
            inputCol="features", outputCol="scaled", withMean=True, withStd=True
        )
        # The penalty is 1/2 |b|^2 against a sum of losses; MLlib minimises the mean loss.
        regression = LogisticRegression(
            featuresCol="scaled",
            labelCol=LABEL,
            weightCol=WEIGHT,
            regParam=1.0 / n,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=2000,
            tol=1e-9,
        )
        return Pipeline(stages=[scaler, regression])

    return ModelSpec(name, tuple(columns), build, BALANCED, penalty=1.0)


def forest(
    columns: Sequence[str], name: str = "random forest", *, trees: int, depth: int = MAX_DEPTH,
    min_leaf: int = 1, feature_share: float | None = None, seed: int = 42,
) -> ModelSpec:
    """Random forest on balanced classes."""

    def build(n: int) -> Estimator:
        return RandomForestClassifier(
            labelCol=LABEL,
            weightCol=WEIGHT,
            numTrees=trees,
            maxDepth=depth,
            minInstancesPerNode=min_leaf,
            featureSubsetStrategy="sqrt" if feature_share is None else str(feature_share),
            seed=seed,
        )

    size = deep_forest.DeepForest(trees, depth, seed, min_leaf, feature_share)
    return ModelSpec(name, tuple(columns), build, BALANCED, bagged=size)


def grown_out_forest(
    columns: Sequence[str], name: str = "random forest", *, trees: int, seed: int = 42
) -> ModelSpec:
    """Random forest on balanced classes whose trees have no limit but MLlib's greatest depth."""
    return forest(columns, name, trees=trees, seed=seed).grown_in_tasks()


def boosting(
    columns: Sequence[str], name: str = "boosting", *, trees: int, depth: int = 6,
    rate: float = 0.3, row_share: float = 1.0, feature_share: float = 1.0, min_leaf: int = 1,
    seed: int = 42,
) -> ModelSpec:
    """Gradient-boosted trees; positives weigh as many times more as they are rarer."""

    def build(n: int) -> Estimator:
        return GBTClassifier(
            labelCol=LABEL,
            weightCol=WEIGHT,
            maxIter=trees,
            maxDepth=depth,
            stepSize=rate,
            subsamplingRate=row_share,
            featureSubsetStrategy="all" if feature_share >= 1.0 else str(feature_share),
            minInstancesPerNode=min_leaf,
            seed=seed,
        )

    size = joint_boosting.Boosting(trees, depth, rate, row_share, feature_share, min_leaf, seed)
    return ModelSpec(name, tuple(columns), build, POSITIVE_RATIO, boosted=size)


def base_models(
    tree_columns: Sequence[str], linear_columns: Sequence[str], config: Config
) -> list[ModelSpec]:
    """The four models before tuning."""
    trees = config.trees(config.base_trees)
    return [
        logistic(linear_columns, "logistic (base)"),
        grown_out_forest(tree_columns, "random forest (base)", trees=trees, seed=config.seed),
        boosting(tree_columns, "boosting (base)", trees=trees, depth=6, rate=0.3, seed=config.seed),
        boosting(
            tree_columns, "deep boosting (base)", trees=trees, depth=8, rate=0.1, min_leaf=20,
            seed=config.seed,
        ),
    ]


def test_scores(specs: Sequence[ModelSpec], rows: DataFrame, config: Config) -> DataFrame:
    """Fit each model on the training rows and score the test rows."""
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'").drop("fold")
    linear, trees = by_kind(specs)
    grown = [s for s in trees if s.ensemble is not None]
    others = [s for s in trees if s.ensemble is None]
    counts = class_counts(train) if trees else None
    jobs = [lambda s=s: score(s, fit(s, train, counts), test) for s in others]
    if grown:
        fits = [
            task_fits.Fit(s.name, s.columns, s.ensemble, 1, counts.weights(s.weighting))
            for s in grown
        ]
        parts = train.withColumn("fold", F.lit(0)).unionByName(test.withColumn("fold", F.lit(1)))
        own = grown_scores(fits, parts, config, {1: counts.rows})
        jobs = [lambda job=job: job().drop("fold") for job in own] + jobs
    if linear:
        jobs.append(lambda: linear_scores(irls.fit_all(train, linear, LABEL), test))
    return written(jobs, config.parallelism)


def coded_rows(
    fits: Sequence[task_fits.Fit], rows: DataFrame, seed: int
) -> task_fits.Coded:
    """The rows as tasks take them: coded for every fold that a fit holds out."""
    columns = list(dict.fromkeys(c for f in fits for c in f.columns))
    held = sorted({f.held for f in fits})
    return task_fits.coded(rows, columns, held, seed, ID, LABEL, "fold")


def grown_scores(
    fits: Sequence[task_fits.Fit], rows: DataFrame, config: Config, sizes: Mapping[int, int],
    table: task_fits.Coded | None = None,
) -> list[Callable[[], DataFrame]]:
    """Jobs that score the held rows of ensembles grown in tasks. ``sizes`` are the training rows of
    each held fold; ``table`` the rows, if they have been coded already."""
    if max(sizes.values()) <= task_fits.FIT_ROWS:

        def whole() -> DataFrame:
            own = coded_rows(fits, rows, fits[0].ensemble.seed) if table is None else table
            return task_fits.held_scores(own, fits, "label", "fold")

        return [whole]

    def deep(f: task_fits.Fit) -> DataFrame:
        inside = rows.where(F.col("fold").isNotNull())
        found = deep_forest.test_scores(
            f.ensemble, inside.where(F.col("fold") != f.held), inside.where(F.col("fold") == f.held),
            f.columns, ID, LABEL, sizes[f.held], f.class_weights,
        )
        own = F.lit(f.held).cast(rows.schema["fold"].dataType).alias("fold")
        return found.select(F.lit(f.name).alias("model"), ID, "label", "score", own)

    forests = [f for f in fits if isinstance(f.ensemble, deep_forest.DeepForest)]
    boosted = [
        joint_boosting.Fit(f.name, f.columns, f.ensemble, f.held, f.class_weights)
        for f in fits if f not in forests
    ]
    jobs = [lambda f=f: deep(f) for f in forests]
    if boosted:
        jobs.insert(0, lambda: joint_boosting.held_scores(boosted, rows, ID, LABEL, "fold"))
    return jobs


def by_kind(specs: Sequence[ModelSpec]) -> tuple[list[irls.Fit], list[ModelSpec]]:
    """Logistic regressions, which are fitted together, and models that are fitted one by one."""
    linear = [s.linear() for s in specs if s.penalty is not None]
    return linear, [s for s in specs if s.penalty is None]


def linear_scores(
    fitted: Sequence[irls.Fitted], rows: DataFrame, fold: str | None = None
) -> DataFrame:
    """Score table of logistic regressions; with ``fold`` each row by the fits that never saw it."""
    keep = [F.col(ID), F.col(LABEL).cast("int").alias("label"), *([F.col(fold)] if fold else [])]
    found = irls.scored(rows, fitted, keep, fold)
    return found.select("model", ID, "label", "score", *([fold] if fold else []))


def written(jobs: Sequence[Callable[[], DataFrame]], parallelism: int) -> DataFrame:
    """Run jobs that each make a score table, and read what all of them have written.

    A job writes its table as soon as its model is fitted and then lets go of the model: at most
    ``parallelism`` models live at once, and the result is one scan, however many fits there are.
    """
    tables = PartTables(SparkSession.active(), "scores")
    run_parallel(
        [lambda k=k, job=job: tables.add(k, job()) for k, job in enumerate(jobs)], parallelism
    )
    return tables.read()


def oof_scores(
    specs: Sequence[ModelSpec], train: DataFrame, config: Config, folds: int | None = None,
    table: task_fits.Coded | None = None,
) -> DataFrame:
    """Out-of-fold scores: every training row is scored once, by a model that never saw it. With
    ``folds`` only the rows of the first so many are scored; the fits are the same. ``table`` are
    the rows as tasks take them, if they have been coded already."""
    folds = config.cv_folds if folds is None else folds

    counts = counts_by_fold(train)
    total = sum_counts(counts.values())

    def rest(fold: int) -> ClassCounts:
        return total - counts.get(fold, ClassCounts(0, 0))

    def one(spec: ModelSpec, fold: int) -> DataFrame:
        model = fit(spec, train.where(F.col("fold") != fold), rest(fold))
        return score(spec, model, train.where(F.col("fold") == fold))

    linear, trees = by_kind(specs)
    others = [s for s in trees if s.ensemble is None]
    jobs = [
        lambda s=s, k=k: one(s, k) for s in others for k in range(folds)
    ]
    grown = [
        task_fits.Fit(s.name, s.columns, s.ensemble, k, rest(k).weights(s.weighting))
        for s in trees if s.ensemble is not None for k in range(folds)
    ]
    if grown:
        sizes = {k: rest(k).rows for k in range(folds)}
        jobs = grown_scores(grown, train, config, sizes, table) + jobs
    if linear:
        fits = irls.per_fold(linear, folds)
        own = train.where(F.col("fold") < folds)
        jobs.append(lambda: linear_scores(irls.fit_all(train, fits, LABEL, "fold"), own, "fold"))
    return written(jobs, config.parallelism)


def cv_average_precision(oof: DataFrame) -> DataFrame:
    """Average precision of every model in every fold."""
    return average_precision(oof, ("model", "fold"))


# --- hyper-parameter search -------------------------------------------------------------------


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    integer: bool = False
    # Tree counts are scaled by the configuration, so quick runs grow fewer trees.
    is_tree_count: bool = False

    def draw(self, rng: random.Random) -> float:
        if self.log:
            value = math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        else:
            value = rng.uniform(self.low, self.high)
        if self.integer:
            return int(min(self.high, max(self.low, round(value))))
        return value


@dataclass(frozen=True)
class SearchSpace:
    """Ranges of the keyword arguments of a model."""

    name: str
    ranges: Mapping[str, Range]
    make: Callable[..., ModelSpec]


# Ranges of the three searches. Ranges without an MLlib counterpart (leaf penalty,
# leaf count) are left out.
SEARCH_SPACES = [
    SearchSpace(
        "random forest",
        {
            "trees": Range(200, 500, integer=True, is_tree_count=True),
            "depth": Range(4, 20, integer=True),
            "min_leaf": Range(1, 40, log=True, integer=True),
            "feature_share": Range(0.3, 1.0),
        },
        forest,
    ),
    SearchSpace(
        "boosting",
        {
            "trees": Range(100, 800, integer=True, is_tree_count=True),
            "depth": Range(3, 9, integer=True),
            "rate": Range(0.01, 0.3, log=True),
            "row_share": Range(0.6, 1.0),
            "feature_share": Range(0.6, 1.0),
            "min_leaf": Range(1, 20, integer=True),
        },
        boosting,
    ),
    SearchSpace(
        "deep boosting",
        {
            "trees": Range(100, 800, integer=True, is_tree_count=True),
            "depth": Range(3, 10, integer=True),
            "rate": Range(0.01, 0.3, log=True),
            "row_share": Range(0.6, 1.0),
            "feature_share": Range(0.6, 1.0),
            "min_leaf": Range(10, 100, integer=True),
        },
        boosting,
    ),
]


@dataclass(frozen=True)
class Trial:
    """A drawn trial, the last rung it was scored on, and its mean average precision there."""

    drawn: dict
    rung: int
    mean_ap: float


@dataclass(frozen=True)
class SearchResult:
    space: SearchSpace
    trials: list[Trial]

    @property
    def best(self) -> dict:
        """The best trial of the last rung; earlier rungs are other measures and not compared."""
        return max(self.trials, key=lambda t: (t.rung, t.mean_ap)).drawn


@dataclass(frozen=True)
class Rung:
    """What a trial is given on a rung: folds to be scored on, and a share of its trees."""

    folds: int
    tree_share: float
    # Share of the trials that come this far.
    survivors: float


def rungs(config: Config) -> list[Rung]:
    """From few folds and trees for all trials to all folds and trees for a few."""
    few = max(1, round(config.cv_folds / 5))
    return [
        Rung(few, 0.25, 1.0),
        Rung(min(config.cv_folds, 2 * few), 0.5, 1 / 3),
        Rung(config.cv_folds, 1.0, 1 / 9),
    ]


def draw_whole(space: SearchSpace, config: Config, count: int) -> list[dict]:
    """Seeded random draws from a space."""
    rng = random.Random(f"{config.seed}|{space.name}")
    return [{name: r.draw(rng) for name, r in space.ranges.items()} for _ in range(count)]


def with_scaled_trees(space: SearchSpace, config: Config, drawn: Mapping) -> dict:
    return {
        name: config.search_trees(value) if space.ranges[name].is_tree_count else value
        for name, value in drawn.items()
    }


def draw_trials(space: SearchSpace, config: Config) -> list[dict]:
    """Seeded random draws from a space, with the trees that the configuration gives them."""
    return [
        with_scaled_trees(space, config, drawn)
        for drawn in draw_whole(space, config, config.search_trials)
    ]


def _on_rung(space: SearchSpace, drawn: dict, rung: Rung) -> dict:
    return {
        name: max(2, round(value * rung.tree_share)) if space.ranges[name].is_tree_count else value
        for name, value in drawn.items()
    }


def search(
    space: SearchSpace,
    train: DataFrame,
    columns: Sequence[str],
    config: Config,
    steps: Sequence[Rung] | None = None,
) -> SearchResult:
    """Random search by successive halving: mean average precision over the folds of a rung.

    All trials of a rung are scored out of fold together, so their metrics take one aggregation;
    the best of them go on to the next. Every rung is written as a table to a folder that is named
    after the rows, the columns and the settings, so a driver that starts again reads the rungs
    that are done. With fewer trials than the last rung takes, all of them are scored there.
    """
    trials = draw_trials(space, config)
    steps = list(rungs(config) if steps is None else steps)
    last = max(1, math.ceil(len(trials) * steps[-1].survivors))
    if len(trials) <= last or len(trials) < 3:
        steps = [replace(steps[-1], survivors=1.0)]
    folder = RungTables(train, f"{space.name}|{columns}|{trials}|{steps}|{config}")
    left = list(range(len(trials)))
    scored = {k: Trial(drawn, -1, 0.0) for k, drawn in enumerate(trials)}
    for number, rung in enumerate(steps):
        wanted = max(1, math.ceil(len(trials) * rung.survivors))
        left = sorted(sorted(left, key=lambda k: (-scored[k].mean_ap, k))[:wanted])

        def measured(rung: Rung = rung, left: list[int] = left) -> DataFrame:
            specs = [
                space.make(columns, str(k), **_on_rung(space, trials[k], rung), seed=config.seed)
                for k in left
            ]
            oof = oof_scores(specs, train, config, folds=rung.folds)
            by_trial = cv_average_precision(oof).groupBy(F.col("model").cast("int").alias("trial"))
            return by_trial.agg(F.avg("ap").alias("mean_ap"))

        for k, mean_ap in folder.rung(number, measured).items():
            scored[k] = Trial(trials[k], number, mean_ap)
    return SearchResult(space, [scored[k] for k in range(len(trials))])


def sequential_search(
    space: SearchSpace, train: DataFrame, columns: Sequence[str], config: Config,
    table: task_fits.Coded | None = None,
) -> SearchResult:
    """Search by tree-structured Parzen estimators: mean average precision over all folds, with all
    trees, of every trial.

    The first trials are random and scored together; each later one is proposed from the scores of
    all before it. Scores are written a step at a time to a folder that is named after the rows, the
    columns and the settings, so a driver that starts again reads the steps that are done.
    """
    scales = {
        name: parzen.Scale(r.low, r.high, r.log, r.integer) for name, r in space.ranges.items()
    }
    folder = RungTables(train, f"parzen|{space.name}|{columns}|{scales}|{config}")
    drawn: list[dict] = []
    scores: list[float] = []
    step = 0
    while len(drawn) < config.search_trials:
        if drawn:
            rng = random.Random(f"{config.seed}|{space.name}|{len(drawn)}")
            new = [parzen.proposed(scales, drawn, scores, rng)]
        else:
            new = draw_whole(space, config, min(parzen.STARTUP, config.search_trials))

        def measured(new: list[dict] = new) -> DataFrame:
            specs = [
                space.make(
                    columns, str(k), **with_scaled_trees(space, config, d), seed=config.seed
                ).grown_in_tasks()
                for k, d in enumerate(new)
            ]
            oof = oof_scores(specs, train, config, table=table)
            by_trial = cv_average_precision(oof).groupBy(F.col("model").cast("int").alias("trial"))
            return by_trial.agg(F.avg("ap").alias("mean_ap"))

        found = folder.rung(step, measured)
        drawn += new
        scores += [found[k] for k in range(len(new))]
        step += 1
    return SearchResult(
        space,
        [
            Trial(with_scaled_trees(space, config, d), 0, mean_ap)
            for d, mean_ap in zip(drawn, scores, strict=True)
        ],
    )


def coded_for_search(
    train: DataFrame, columns: Sequence[str], config: Config
) -> task_fits.Coded | None:
    """The rows of all trials, coded once; none where they are more than a task takes."""
    if class_counts(train).rows > task_fits.FIT_ROWS:
        return None
    return task_fits.coded(train, columns, range(config.cv_folds), config.seed, ID, LABEL, "fold")


class RungTables:
    """Scores of finished rungs or steps, kept in the shared folder under a name that the same search on
    the same rows finds again."""

    def __init__(self, train: DataFrame, settings: str):
        self.spark = train.sparkSession
        row = train.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64(*train.columns)).alias("rows")
        ).first()
        name = hashlib.sha256(f"{settings}|{row['n']}|{row['rows']}".encode()).hexdigest()[:32]
        self.path = f"{shared_folder(self.spark)}/secondcart/search/{name}"

    def rung(self, number: int, measure: Callable[[], DataFrame]) -> dict[int, float]:
        """The scores of a rung by trial: read if it has been written whole, or else measured."""
        path = f"{self.path}/rung-{number}"
        if not is_written(self.spark, path):
            measure().write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema("trial int, mean_ap double").parquet(path).collect()
        return {r["trial"]: r["mean_ap"] for r in rows}


def search_table(results: Sequence[SearchResult], train: DataFrame) -> DataFrame:
    """Of every trial the last rung it came to and its mean average precision there."""
    rows = [
        (r.space.name, i, t.rung, t.mean_ap) for r in results for i, t in enumerate(r.trials)
    ]
    schema = "model string, trial int, rung int, mean_ap double"
    return train.sparkSession.createDataFrame(rows, schema)


def hp_table(results: Sequence[SearchResult], train: DataFrame) -> DataFrame:
    """Search range and chosen value of every parameter."""
    rows = [
        (r.space.name, name, float(own.low), float(own.high), own.log, round(float(value), 4))
        for r in results
        for name, value in r.best.items()
        for own in [r.space.ranges[name]]
    ]
    return train.sparkSession.createDataFrame(
        rows,
        "model string, hyperparameter string, low double, high double, log_scale boolean,"
        " selected double",
    )


def tuned_models(
    results: Sequence[SearchResult], columns: Sequence[str], config: Config
) -> list[ModelSpec]:
    return [
        r.space.make(
            columns, f"{r.space.name} (tuned)", **r.best, seed=config.seed
        ).grown_in_tasks()
        for r in results
    ]


# --- evaluation -------------------------------------------------------------------------------


def metrics_table(oof: DataFrame, test: DataFrame, config: Config) -> DataFrame:
    """The metric row of every model: pooled out-of-fold average precision, test metrics at the
    threshold chosen out of fold, top-fraction metrics and bootstrap intervals."""
    thresholds = f1_threshold(oof).select("model", "threshold")
    cv_ap = average_precision(oof).withColumnRenamed("ap", "cv_ap")
    intervals = bootstrap_ci(
        bootstrap_metrics(test, ID, config.bootstrap_replicates, config.seed)
    )
    # One row per model on every side.
    joined = reduce(
        lambda a, b: a.join(b, "model"),
        [
            cv_ap,
            ranking_metrics(test),
            threshold_metrics(test, thresholds),
            lift_top(test, ID, config.top_fraction, config.seed),
            intervals,
        ],
    )
    return joined.select(
        "model",
        "cv_ap",
        "auc",
        "ap",
        "threshold",
        "precision",
        "recall",
        "f1",
        "capture_top",
        "lift_top",
        F.format_string("%.3f to %.3f", "auc_low", "auc_high").alias("auc_ci95"),
        F.format_string("%.3f to %.3f", "ap_low", "ap_high").alias("ap_ci95"),
    )


def base_vs_tuned(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Test average precision before and after tuning."""
    family = F.regexp_replace("model", r" \((base|tuned)\)$", "")
    a = average_precision(base).select(family.alias("family"), F.col("ap").alias("base_ap"))
    b = average_precision(tuned).select(family.alias("family"), F.col("ap").alias("tuned_ap"))
    return a.join(b, "family").withColumn("gain", F.col("tuned_ap") - F.col("base_ap"))


def finalist(cv: DataFrame) -> DataFrame:
    """Model with the best pooled cross-validated average precision; never chosen on test."""
    return cv.agg(
        F.max_by("model", F.struct("cv_ap", "model")).alias("model"),
        F.max("cv_ap").alias("cv_ap"),
    )


FULL_MODEL = "full model"


def dropped_columns() -> dict[str, frozenset[str]]:
    """Name of every ablation variant and the columns it goes without."""
    single = {block: [block] for block in FEATURE_BLOCKS}
    return {FULL_MODEL: frozenset()} | {
        f"without {name}": frozenset(chain.from_iterable(FEATURE_BLOCKS[b] for b in blocks))
        for name, blocks in (single | JOINT_BLOCKS).items()
    }


def ablation_variants(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns of the full model and of the model without each block or pair of blocks."""
    return {
        name: [c for c in columns if c not in dropped]
        for name, dropped in dropped_columns().items()
    }


def ablation_folds(spec: ModelSpec, train: DataFrame, config: Config) -> DataFrame:
    """Average precision per variant and fold, all on the same folds."""
    variants = [
        spec.with_columns(name, columns)
        for name, columns in ablation_variants(spec.columns).items()
    ]
    return cv_average_precision(oof_scores(variants, train, config))


def ablation_summary(folds: DataFrame, full: str = FULL_MODEL) -> DataFrame:
    """Mean and spread over folds, and the paired difference to the full model."""
    reference = folds.where(F.col("model") == full).select("fold", F.col("ap").alias("full_ap"))
    return (
        folds.join(reference, "fold")
        .groupBy(F.col("model").alias("variant"))
        .agg(
            F.avg("ap").alias("mean_ap"),
            F.stddev_samp("ap").alias("sd_over_folds"),
            F.avg(F.col("ap") - F.col("full_ap")).alias("difference"),
        )
    )
