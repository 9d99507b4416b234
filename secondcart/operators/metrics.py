"""Ranking and classification metrics over long score tables ``(model, id, label, score)``.

Scores are grouped by distinct value before they are ordered, so ties cost one row, and the
cumulative counts come from bucketed running totals. A row without a score has no rank: ranking
metrics, curves and thresholds leave it out everywhere, in the class totals too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from secondcart.functions.binning import label_of
from secondcart.functions.hashing import hash32
from secondcart.operators.caching import small_table
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.operators.order_stats import (
    ROWS_PER_WINDOW,
    after_cutoff,
    average_ranks,
    bucket_edges,
    hash_cutoffs,
    running_totals,
)
from secondcart.operators.sampling import BLOCK_CELLS, drawn_by_block
from secondcart.sources.writers import materialize


def score_counts(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.where(F.col("score").isNotNull()).groupBy(*groups, "score").agg(
        F.sum("label").cast("bigint").alias("pos"),
        F.sum(1 - F.col("label")).cast("bigint").alias("neg"),
    )


def cum_counts(
    scored: DataFrame,
    groups: Sequence[str] = ("model",),
    edges: Sequence[float] | None = None,
    rows_per_window: int = ROWS_PER_WINDOW,
) -> DataFrame:
    """Per distinct score: its counts, and ``tp``/``fp``, the counts at or above it."""
    return running_totals(
        score_counts(scored, groups),
        groups,
        "score",
        {"tp": F.col("pos"), "fp": F.col("neg")},
        descending=True,
        edges=edges,
        rows_per_window=rows_per_window,
    )


def _auc() -> Column:
    """Area under the ROC curve; ties count half."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return F.try_divide(area, F.sum("pos") * F.sum("neg").cast("double"))


def _average_precision() -> Column:
    """Step-wise average precision: every score's precision, weighted by its recall gain."""
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return F.try_divide(gain, F.sum("pos").cast("double"))


def ranking_metrics(scored: DataFrame, groups: Sequence[str] = ("model",), **options) -> DataFrame:
    """``auc`` and ``ap`` per group in one pass."""
    return (
        cum_counts(scored, groups, **options)
        .groupBy(*groups)
        .agg(_auc().alias("auc"), _average_precision().alias("ap"))
    )


def roc_auc(scored: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    return cum_counts(scored, groups).groupBy(*groups).agg(_auc().alias("auc"))


def average_precision(scored: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    return cum_counts(scored, groups).groupBy(*groups).agg(_average_precision().alias("ap"))


def _class_totals(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives per group, as local rows: there are few models."""
    totals = scored.where(F.col("score").isNotNull()).groupBy(*groups).agg(
        F.sum("label").cast("bigint").alias("n_pos"),
        F.sum(1 - F.col("label")).cast("bigint").alias("n_neg"),
    )
    return small_table(totals)


def roc_curve(scored: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """All points of the ROC curve; the point above every score has a NULL threshold."""
    totals = _class_totals(scored, groups)
    points = cum_counts(scored, groups).join(F.broadcast(totals), list(groups)).select(
        *groups,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )
    origin = totals.select(
        *groups,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def pr_curve(scored: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """All points of the precision-recall curve; the end point (recall 0, precision 1) has a
    NULL threshold."""
    totals = _class_totals(scored, groups)
    points = cum_counts(scored, groups).join(F.broadcast(totals), list(groups)).select(
        *groups,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "n_pos").alias("recall"),
    )
    end = totals.select(
        *groups,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def f1_threshold(scored: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Score with the best F1 when used as a threshold, the lowest one on ties."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    return (
        pr_curve(scored, groups)
        .where(F.col("threshold").isNotNull())
        .withColumn("f1", f1)
        .groupBy(*groups)
        .agg(
            F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
            F.max("f1").alias("f1"),
        )
    )


def _scored_with(scored: DataFrame, thresholds: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Scores with their group's threshold and the prediction ``score >= threshold``."""
    limits = small_table(thresholds.select(*groups, "threshold"))
    return scored.join(F.broadcast(limits), list(groups)).withColumn(
        "predicted", (F.col("score") >= F.col("threshold")).cast("int")
    )


def confusion(
    scored: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ("model",)
) -> DataFrame:
    """Confusion counts per group. ``thresholds`` has one row per group (a model)."""
    actual, predicted = F.col("label") == 1, F.col("predicted") == 1
    return (
        _scored_with(scored, thresholds, groups)
        .groupBy(*groups, "threshold")
        .agg(
            F.count_if(~actual & ~predicted).alias("tn"),
            F.count_if(~actual & predicted).alias("fp"),
            F.count_if(actual & ~predicted).alias("fn"),
            F.count_if(actual & predicted).alias("tp"),
        )
    )


def threshold_metrics(
    scored: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ("model",)
) -> DataFrame:
    """Precision, recall and F1 at a threshold; undefined ratios are 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return confusion(scored, thresholds, groups).select(
        *groups,
        "threshold",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def lift_top(
    scored: DataFrame, id_column: str, fraction: float, seed: int,
    rows_per_window: int = ROWS_PER_WINDOW,
) -> DataFrame:
    """Precision, capture and lift among the ``ceil(fraction * rows)`` highest scores per model.

    Rows tied at the boundary score are taken in the order of a hash of their id. The boundary
    score comes from the cumulative counts, and only the tied rows are looked at one by one.
    """
    counted = cum_counts(scored, ("model",), rows_per_window=rows_per_window)
    totals = _class_totals(scored, ("model",)).withColumn(
        "n_top", F.ceil((F.col("n_pos") + F.col("n_neg")) * F.lit(fraction)).cast("bigint")
    )
    seen = F.col("tp") + F.col("fp")
    boundary = (
        counted.join(F.broadcast(totals), "model")
        .where((seen >= F.col("n_top")) & (seen - F.col("pos") - F.col("neg") < F.col("n_top")))
        .select(
            "model",
            F.col("score").alias("boundary"),
            "n_pos",
            "n_neg",
            "n_top",
            (F.col("tp") - F.col("pos")).alias("pos_above"),
            (F.col("n_top") - (seen - F.col("pos") - F.col("neg"))).alias("n_tied"),
        )
    ).collect()  # one row per model
    if not boundary:
        raise ValueError("no scores")
    spark = scored.sparkSession
    limits = spark.createDataFrame(
        boundary,
        "model string, boundary double, n_pos bigint, n_neg bigint, n_top bigint,"
        " pos_above bigint, n_tied bigint",
    )
    tied = scored.join(
        F.broadcast(limits.select("model", F.col("boundary").alias("score"))), ["model", "score"]
    )
    take = {row["model"]: row["n_tied"] for row in boundary}
    h = hash32(seed, "top", id_column)
    cutoffs = hash_cutoffs(tied, "model", h, id_column, lambda model, n: [min(take[model], n)])
    taken = F.lit(False)
    for model, cuts in cutoffs.items():
        taken = taken | ((F.col("model") == model) & ~after_cutoff(h, id_column, cuts[0]))
    tied_positives = tied.where(taken).groupBy("model").agg(F.sum("label").alias("pos_tied"))
    hits = F.col("pos_above") + F.coalesce(F.col("pos_tied"), F.lit(0))
    precision = hits / F.col("n_top")
    prevalence = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return limits.join(tied_positives, "model", "left").select(
        "model",
        "n_top",
        precision.alias("precision_top"),
        F.try_divide(hits, F.col("n_pos")).alias("capture_top"),
        F.try_divide(precision, prevalence).alias("lift_top"),
    )


def _score_counts(values: pa.Array) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A row for each replicate: its draws by model, score and label in a block of cells."""
    flat, sizes = values.flatten(), values.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    model = flat.field("model").dictionary_encode().indices.fill_null(-1).to_numpy()
    score = np.unique(
        flat.field("score").to_numpy(zero_copy_only=False), return_inverse=True
    )[1].astype(np.int64)
    _, first, key = np.unique(
        model * np.int64(len(score) + 1) + score, return_index=True, return_inverse=True
    )
    label = flat.field("label")
    positive = label.fill_null(0).to_numpy()
    negative = np.where(label.is_null().to_numpy(zero_copy_only=False), 0, 1 - positive)

    def made(
        replicate: np.ndarray, place: np.ndarray, draws: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        found, own = np.unique(replicate, return_inverse=True)
        n_each = sizes[place]
        total = int(n_each.sum())
        at = np.arange(total) + np.repeat(starts[place] - (np.cumsum(n_each) - n_each), n_each)
        index = np.repeat(own, n_each) * len(first) + key[at]
        n, size = np.repeat(draws, n_each), len(found) * len(first)
        some = np.flatnonzero(np.bincount(index, minlength=size))
        pos, neg = (np.bincount(index, n * y[at], size)[some] for y in (positive, negative))
        ends = np.searchsorted(some, np.arange(len(found) + 1) * len(first)).astype(np.int32)
        entry = flat.take(pa.array(first[some % len(first)]))
        counts = pa.StructArray.from_arrays(
            [
                entry.field("model"),
                entry.field("score"),
                pa.array(pos.astype(np.int64)),
                pa.array(neg.astype(np.int64)),
            ],
            names=["model", "score", "pos", "neg"],
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), counts)],
            names=["replicate", "counts"],
        )

    return made


def bootstrap_metrics(
    scored: DataFrame, id_column: str, replicates: int, seed: int, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """``auc`` and ``ap`` per model and replicate; replicates with one class only are skipped.

    Every model is scored on the same draws: a draw takes a person with the scores of all models.
    Persons with the same label and scores are one cell, and a replicate is a number of draws per
    cell. Draws of a block of cells are added up by score where they are made; only sums are
    shuffled.
    """
    scored = scored.where(F.col("score").isNotNull())
    cells = (
        scored.groupBy(id_column)
        .agg(F.array_sort(F.collect_list(F.struct("model", "label", "score"))).alias("cells"))
        .groupBy("cells")
        .agg(F.count("*").alias("persons"), F.min(id_column).alias("first"))
    )
    kinds = scored.schema
    count = (
        StructType()
        .add("model", kinds["model"].dataType)
        .add("score", kinds["score"].dataType)
        .add("pos", "long")
        .add("neg", "long")
    )
    drawn = drawn_by_block(
        cells, "first", "persons", "cells", replicates, seed, block_cells, _score_counts,
        StructType().add("replicate", "integer").add("counts", ArrayType(count)),
    )
    counts = (
        drawn.select("replicate", F.inline("counts"))
        .groupBy("model", "replicate", "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # The distinct scores of all replicates are those of the score table, so the bucket bounds
    # come from the small side.
    edges = bucket_edges(scored.select("model", "score").distinct(), "score")
    cumulated = running_totals(
        counts, ("model", "replicate"), "score", {"tp": F.col("pos"), "fp": F.col("neg")},
        descending=True, edges=edges,
    )
    return (
        cumulated.groupBy("model", "replicate")
        .agg(
            _auc().alias("auc"),
            _average_precision().alias("ap"),
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
        )
        .where("n_pos > 0 and n_neg > 0")
        .drop("n_pos", "n_neg")
    )


def bootstrap_ci(replicated: DataFrame) -> DataFrame:
    """95% percentile intervals. One value per replicate, so the exact aggregate is bounded."""
    low_high = F.lit([0.025, 0.975])
    auc = F.percentile("auc", low_high)
    ap = F.percentile("ap", low_high)
    return replicated.groupBy("model").agg(
        F.count("*").alias("n_replicates"),
        auc[0].alias("auc_low"),
        auc[1].alias("auc_high"),
        ap[0].alias("ap_low"),
        ap[1].alias("ap_high"),
    )


def paired_bootstrap_diff(replicated: DataFrame, first: str, second: str) -> DataFrame:
    """Difference in average precision of two models on the same replicates."""
    a = replicated.where(F.col("model") == first).select("replicate", F.col("ap").alias("a"))
    b = replicated.where(F.col("model") == second).select("replicate", F.col("ap").alias("b"))
    difference = F.col("a") - F.col("b")
    bounds = F.percentile(difference, F.lit([0.025, 0.975]))
    return a.join(b, "replicate").agg(
        F.lit(first).alias("first_model"),
        F.lit(second).alias("second_model"),
        F.count("*").alias("n_replicates"),
        F.avg(difference).alias("mean_difference"),
        bounds[0].alias("ci_low"),
        bounds[1].alias("ci_high"),
    )


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per group, ties sharing their mean rank.

    Works on distinct (x, y) pairs, written once because both rankings and the result read them.
    A value of ``x`` that fills a third of the rows may still have very many pairs, so its rank is
    attached with a join that spreads hot keys.
    """
    group = F.concat_ws("|", *[F.col(g).cast("string") for g in groups]) if groups else F.lit("")
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(group.alias("_g"), *groups, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .groupBy("_g", *groups, "_x", "_y")
        .agg(F.count("*").alias("_w"))
    )
    pairs = materialize(pairs, "pairs")

    def ranked(frame: DataFrame, value: str) -> DataFrame:
        counts = pairs.groupBy("_g", value).agg(
            F.sum("_w").alias("_n"), F.count("*").alias("_pairs")
        )
        ranks = average_ranks(counts, value, ["_g"], "_n")
        keyed = ranks.select(
            F.struct("_g", value).alias("_key"),
            F.col("centered_rank").alias(f"{value}_rank"),
            "_pairs",
        )
        return lookup_by_hot_key(
            frame.withColumn("_key", F.struct("_g", value)), keyed, "_key", "_pairs"
        ).drop("_key", "_pairs")

    with_ranks = ranked(ranked(pairs, "_x"), "_y")
    a, b, w = F.col("_x_rank"), F.col("_y_rank"), F.col("_w")
    spread = F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))
    return (
        with_ranks.groupBy("_g", *groups)
        .agg(F.try_divide(F.sum(w * a * b), spread).alias("spearman"))
        .drop("_g")
    )


def classification_report(predicted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    ``predicted`` has integer columns ``label`` and ``prediction``; only class counts are kept
    after the first aggregation.
    """
    classes = F.explode(F.array(*[F.lit(i) for i in range(len(names))])).alias("class")
    counts = predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    is_label, is_predicted = F.col("label") == F.col("class"), F.col("prediction") == F.col("class")
    n = F.col("n")
    per_class = (
        counts.select("*", classes)
        .groupBy("class")
        .agg(
            F.sum(F.when(is_label & is_predicted, n).otherwise(0)).alias("tp"),
            F.sum(F.when(is_label, n).otherwise(0)).alias("support"),
            F.sum(F.when(is_predicted, n).otherwise(0)).alias("n_predicted"),
        )
        .select(
            label_of(F.col("class"), names).alias("class"),
            F.coalesce(F.try_divide("tp", "n_predicted"), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
            F.coalesce(
                F.try_divide(2 * F.col("tp"), F.col("support") + F.col("n_predicted")), F.lit(0.0)
            ).alias("f1"),
            "support",
            "tp",
        )
    )
    total = F.sum("support")

    def weighted(column: str) -> Column:
        return F.try_divide(F.sum(F.col(column) * F.col("support")), total)

    accuracy = F.try_divide(F.sum("tp"), total)
    summary = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                accuracy.alias("precision"),
                accuracy.alias("recall"),
                accuracy.alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro average").alias("class"),
                F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted average").alias("class"),
                weighted("precision").alias("precision"),
                weighted("recall").alias("recall"),
                weighted("f1").alias("f1"),
                total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("tp").unionByName(summary)
