"""The three batch jobs: the study, the regression on its stored base, and review sentiment.

Each reads its inputs, runs, and writes tables below an output folder. The study writes the base
the regression reads; the sentiment job writes a table the study reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.binning import cut_right
from secondcart.functions.lookups import (
    CATEGORY_DURABILITY,
    DELIVERY_EDGES,
    DELIVERY_LABELS,
    POLARITY_NAMES,
    QUARTILE_LABELS,
)
from secondcart.operators import cohort, describe, features, inference, metrics, models
from secondcart.operators.caching import persisted, small_table
from secondcart.operators.quality import assert_golden, assert_not_null
from secondcart.operators.sentiment import (
    cross_fit,
    sentiment_table,
    with_review_text,
    word_table,
)
from secondcart.plans.study import (
    ITEM_ORDER,
    Study,
    proportion_comparisons,
    with_split_and_folds,
)
from secondcart.sources.checkpoints import read_checkpoint, write_checkpoint
from secondcart.sources.writers import materialize, write_result, write_table

GOLDEN_TOLERANCE = 0.0006


def study_job(
    tables: Mapping[str, DataFrame],
    out: str,
    config: Config = Config(),
    durability: Mapping[str, int] = CATEGORY_DURABILITY,
    item_order: Sequence[str] = ITEM_ORDER,
    delivered_status: str = cohort.DELIVERED,
) -> Study:
    """Cohort, descriptive tables, models, ablation, attributions; writes everything."""
    study = Study(
        tables, config, durability, item_order, delivered_status=delivered_status
    )
    study.check()
    base = study.base

    reports = {
        "table_counts": describe.table_counts(tables),
        "source_profile": describe.source_profile(
            study.delivered(), models.ID, "order_purchase_timestamp"
        ),
        "cohort_funnel": cohort.cohort_funnel(study.cohort()),
        "split_cart_customers": cohort.split_cart_customers(study.cohort()),
        "missingness": features.missingness_report(study.features, durability),
        "rate_by_rating": describe.rate_by(base, "rating"),
        "rate_by_durability": describe.rate_by(base, "durable"),
        "rate_by_delivery": describe.rate_by_bin(
            base, cut_right(F.col("slack_days"), DELIVERY_EDGES), DELIVERY_LABELS
        ),
        "rate_by_value_quartile": describe.rate_by_quantile(base, "first_value", QUARTILE_LABELS),
        "candidate_screen": describe.screen_candidates(
            base, ["first_freight", "posting_days"], config.screen_min_range
        ),
        "proportion_tests": study.proportion_tests(),
        "class_weights": models.class_weights(study.train),
        "base_models": metrics.ranking_metrics(study.base_scores),
        "logit": study.logit_table(),
        "logit_fit": inference.fit_stats(study.logit, study.design("train")),
        "logit_test_metrics": metrics.ranking_metrics(study.logit_scores()),
        "block_tests": inference.block_lr_test(
            study.logit, study.design("train"), study.spec.columns()
        ),
        "hyperparameters": models.hp_table(study.searches, base),
        "metrics": study.metrics(),
        "base_vs_tuned": models.base_vs_tuned(study.base_scores, study.final_scores),
        "boosting_difference": boosting_difference(study),
        "finalist_confusion": finalist_confusion(study),
        "ablation": models.ablation_summary(study.ablation_folds),
        "shap_importance": study.shap_importance(),
    }
    for name, report in reports.items():
        write_result(report, f"{out}/{name}")

    # Curves have a point per distinct score, so they are written like tables.
    write_table(metrics.roc_curve(study.final_scores), f"{out}/roc_curve")
    write_table(metrics.pr_curve(study.final_scores), f"{out}/pr_curve")
    write_checkpoint(study.modeling_base(), f"{out}/modeling_base")
    write_checkpoint(state_levels(base), f"{out}/state_levels")
    return study


def boosting_difference(study: Study) -> DataFrame:
    """Paired bootstrap difference of the two tuned boosting models."""
    c = study.config
    replicated = metrics.bootstrap_metrics(
        study.final_scores, models.ID, c.bootstrap_replicates, c.seed
    )
    return metrics.paired_bootstrap_diff(
        replicated, "boosting (tuned)", "deep boosting (tuned)"
    )


def finalist_confusion(study: Study) -> DataFrame:
    name = study.finalist.name
    oof = study.final_oof.where(F.col("model") == name)
    test = study.final_scores.where(F.col("model") == name)
    return metrics.confusion(test, metrics.f1_threshold(oof))


def state_levels(base: DataFrame) -> DataFrame:
    """Code and name of every state group."""
    return base.select("state_code", "state_group").distinct()


def regression_job(
    spark: SparkSession,
    study_out: str,
    out: str,
    config: Config = Config(),
    expected: DataFrame | None = None,
) -> None:
    """Inferential regression on the base a study has written.

    ``expected`` holds stored coefficients ``(term, coefficient)`` of the specification with
    three text columns; when they are not reproduced the job stops before anything is written, as
    it does when the base is not what its manifest says.
    """
    base = read_checkpoint(spark, f"{study_out}/modeling_base")
    levels = read_checkpoint(spark, f"{study_out}/state_levels").orderBy("state_code")
    names = [row["state_group"] for row in small_table(levels).collect()]
    decoded = features.decode_levels(base, "state_code", names, "state_group")
    assert_not_null(decoded, ["state_group"])
    rows = materialize(with_split_and_folds(decoded, config), "regression-rows")
    train = rows.where("split = 'train'")
    spec = inference.linear_spec(rows, config.clip_low, config.clip_high)

    def design(text: str) -> DataFrame:
        keep = (models.ID, models.LABEL, "split", "fold")
        return inference.design_matrix(rows, spec, text, keep)

    if expected is not None:
        separate, columns = design(inference.SEPARATE_TEXT), spec.columns(inference.SEPARATE_TEXT)
        fit_rows = separate.where("split = 'train'")
        earlier = inference.logit_table(
            inference.fit_logit(fit_rows, columns), fit_rows, columns
        )
        assert_golden(earlier, expected, "term", "coefficient", GOLDEN_TOLERANCE)

    columns = spec.columns()
    with persisted(design(inference.NET_TEXT)) as net:
        fit_rows, test_rows = net.where("split = 'train'"), net.where("split = 'test'")
        logit = inference.fit_logit(fit_rows, columns)
        logistic = models.logistic(columns)
        oof = models.oof_scores([logistic], fit_rows, config)
        test = models.test_scores([logistic], net, config)
        reports = {
            "logit": inference.logit_table(logit, fit_rows, columns),
            "logit_fit": inference.fit_stats(logit, fit_rows),
            "logit_test_metrics": metrics.ranking_metrics(
                inference.logit_scores(logit, test_rows, columns)
            ),
            "block_tests": inference.block_lr_test(logit, fit_rows, columns),
            "logistic_metrics": models.metrics_table(
                materialize(oof, "regression-oof"), materialize(test, "regression-test"), config
            ),
            "split_summary": rows.groupBy("split").agg(
                F.count("*").alias("n"), F.avg(models.LABEL).alias("prevalence")
            ),
            "train_profile": models.class_weights(train),
            "proportion_tests": describe.two_proportion_tests(
                rows, proportion_comparisons(), config.alpha
            ),
        }
        for name, report in reports.items():
            write_result(report, f"{out}/{name}")


def sentiment_job(reviews: DataFrame, out: str, config: Config = Config()) -> None:
    """Cross-fitted sentiment of every review with a text; writes the table and its quality."""
    with_text = with_review_text(reviews)
    with persisted(word_table(with_text.where("has_text = 1"))) as labelled:
        scored = cross_fit(labelled, config.text_folds, config.seed).drop("counts")
        scored = materialize(scored, "sentiment-scores")
    write_table(sentiment_table(with_text, scored), f"{out}/sentiment")
    write_result(metrics.classification_report(scored, POLARITY_NAMES), f"{out}/sentiment_report")
