"""The whole study over one set of logical tables.

A study writes its customer table once and every later step reads that table, as the model jobs
of a real run would. Fitted models and score tables are kept the same way, so asking for the
metrics after the ablation does not fit everything again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.lookups import CATEGORY_DURABILITY, TREE_FEATURES
from secondcart.operators import cohort, explain, features, inference, models, sampling, sentiment
from secondcart.operators.caching import few_partitions, persisted
from secondcart.operators.describe import two_proportion_tests
from secondcart.operators.quality import assert_not_null, assert_same_count, assert_unique
from secondcart.sources.writers import materialize

ITEM_ORDER = ("order_item_id", "product_id")


def with_split_and_folds(base: DataFrame, config: Config) -> DataFrame:
    """Adds ``split``, and ``fold`` in the training rows. Membership depends on the seed and the
    person only, so any job that reads the same persons finds the same rows in the same place."""
    split = sampling.stratified_split(
        base, models.ID, models.LABEL, config.test_share, config.seed
    )
    return sampling.stratified_folds(
        split,
        models.ID,
        models.LABEL,
        config.cv_folds,
        config.seed,
        within=F.col("split") == "train",
    )


def proportion_comparisons() -> dict[str, tuple[Column, Column]]:
    return {
        "not durable / durable": (F.col("durable") == 0, F.col("durable") == 1),
        "on time / late": (F.col("late_flag") == 0, F.col("late_flag") == 1),
        "rating 4-5 / rating 1-2": (F.col("rating") >= 4, F.col("rating") <= 2),
    }


class Study:
    """Lazy plans, and tables and models that are made once and kept."""

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        config: Config,
        durability: Mapping[str, int] = CATEGORY_DURABILITY,
        item_order: Sequence[str] = ITEM_ORDER,
        reviews: Callable[[], DataFrame] | None = None,
        delivered_status: str = cohort.DELIVERED,
    ):
        self.tables = tables
        self.config = config
        self.durability = durability
        self.item_order = item_order
        self._reviews = reviews
        self.delivered_status = delivered_status

    # --- lazy parts: plans over the source tables ---------------------------------------------

    def delivered(self) -> DataFrame:
        delivered = cohort.delivered_orders(self.tables["orders"], self.delivered_status)
        return cohort.orders_with_customer(delivered, self.tables["customers"])

    # --- written once -------------------------------------------------------------------------

    @cached_property
    def _cohort(self) -> DataFrame:
        persons = cohort.purchase_cohort(self.delivered(), self.config.horizon_days)
        return materialize(persons, "cohort")

    def cohort(self) -> DataFrame:
        """One row per person: first order, repeat, eligibility and outcome. Funnel, checks and
        features all start here, so the orders are read for it once."""
        return self._cohort

    def first_order_features(self) -> DataFrame:
        return features.first_order_features(
            cohort.sample_of(self.cohort()), self.tables, self.item_order
        )

    @cached_property
    def features(self) -> DataFrame:
        """Features before imputation."""
        return materialize(self.first_order_features(), "features")

    def imputed(self) -> DataFrame:
        return features.imputed_features(self.features, self.config.top_states, self.durability)

    def modeling_base(self) -> DataFrame:
        return features.modeling_base(self.imputed())

    @cached_property
    def base(self) -> DataFrame:
        """Imputed features with codes, one row per person of the sample."""
        imputed = self.imputed()
        coded = imputed.withColumn("state_code", features.alpha_code(imputed, "state_group"))
        return materialize(coded, "base")

    @cached_property
    def rows(self) -> DataFrame:
        """The base with ``split`` and, in the training rows, ``fold``."""
        return materialize(with_split_and_folds(self.base, self.config), "rows")

    def check(self) -> None:
        """Raises when an order has no person, or a join repeated or lost a person."""
        assert_not_null(self.delivered(), ["customer_unique_id"])
        assert_same_count(cohort.sample_of(self.cohort()), self.features)
        assert_unique(self.features, models.ID)

    # --- linear models ------------------------------------------------------------------------

    @cached_property
    def spec(self) -> inference.LinearSpec:
        return inference.linear_spec(self.rows, self.config.clip_low, self.config.clip_high)

    def design(self, split: str | None = None, text: str = inference.NET_TEXT) -> DataFrame:
        rows = self.rows if split is None else self.rows.where(F.col("split") == split)
        return inference.design_matrix(rows, self.spec, text, keep=(models.ID, models.LABEL))

    @cached_property
    def logit(self):
        return inference.fit_logit(self.design("train"), self.spec.columns())

    def logit_table(self) -> DataFrame:
        return inference.logit_table(self.logit, self.design("train"), self.spec.columns())

    def logit_scores(self) -> DataFrame:
        return inference.logit_scores(self.logit, self.design("test"), self.spec.columns())

    def proportion_tests(self) -> DataFrame:
        return two_proportion_tests(self.base, proportion_comparisons(), self.config.alpha)

    # --- classifiers --------------------------------------------------------------------------

    @property
    def tree_columns(self) -> list[str]:
        return list(TREE_FEATURES)

    @property
    def linear_columns(self) -> list[str]:
        return [f"lin_{c}" for c in self.spec.columns()]

    @cached_property
    def model_rows(self) -> DataFrame:
        """Tree features and linear terms (prefixed) side by side, the input of every fit."""
        trees = {f"tree_{c}": F.col(c) for c in TREE_FEATURES}
        design = inference.design_matrix(
            self.rows.withColumns(trees),
            self.spec,
            keep=(models.ID, models.LABEL, "split", "fold", *trees),
        )
        renamed = {t: f"lin_{t}" for t in self.spec.columns()} | {
            f"tree_{c}": c for c in TREE_FEATURES
        }
        return materialize(design.withColumnsRenamed(renamed), "model-rows")

    @property
    def train(self) -> DataFrame:
        return self.model_rows.where("split = 'train'")

    @cached_property
    def base_scores(self) -> DataFrame:
        specs = models.base_models(self.tree_columns, self.linear_columns, self.config)
        with persisted(few_partitions(self.model_rows)) as rows:
            scores = models.test_scores(specs, rows, self.config)
            return materialize(scores, "base-scores")

    @cached_property
    def searches(self) -> list[models.SearchResult]:
        with persisted(few_partitions(self.train)) as train:
            columns = self.tree_columns
            table = models.coded_for_search(train, columns, self.config)
            jobs = [
                lambda space=space: models.sequential_search(
                    space, train, columns, self.config, table
                )
                for space in models.SEARCH_SPACES
            ]
            return models.run_parallel(jobs, self.config.parallelism)

    @cached_property
    def final_specs(self) -> list[models.ModelSpec]:
        tuned = models.tuned_models(self.searches, self.tree_columns, self.config)
        return [models.logistic(self.linear_columns), *tuned]

    @cached_property
    def final_scores(self) -> DataFrame:
        """Test scores of the logistic and the tuned models."""
        with persisted(few_partitions(self.model_rows)) as rows:
            return materialize(
                models.test_scores(self.final_specs, rows, self.config), "test-scores"
            )

    @cached_property
    def final_oof(self) -> DataFrame:
        with persisted(few_partitions(self.train)) as train:
            return materialize(
                models.oof_scores(self.final_specs, train, self.config), "oof-scores"
            )

    def metrics(self) -> DataFrame:
        return models.metrics_table(self.final_oof, self.final_scores, self.config)

    @cached_property
    def finalist(self) -> models.ModelSpec:
        """Tuned tree model with the best pooled cross-validated average precision."""
        tuned = self.final_oof.where(F.col("model").endswith("(tuned)"))
        cv = models.average_precision(tuned).withColumnRenamed("ap", "cv_ap")
        chosen = models.finalist(cv).first()["model"]
        return next(s for s in self.final_specs if s.name == chosen)

    @cached_property
    def ablation_folds(self) -> DataFrame:
        with persisted(few_partitions(self.train)) as train:
            folds = models.ablation_folds(self.finalist, train, self.config)
            return materialize(folds, "ablation")

    @cached_property
    def _finalist_model(self):
        with persisted(few_partitions(self.train)) as train:
            return models.fit(self.finalist, train)

    def explain_sample(self) -> DataFrame:
        """A fixed number of test rows, for explaining a few of very many."""
        return sampling.hash_sample(
            self.model_rows.where("split = 'test'"),
            models.ID,
            self.config.explain_rows,
            self.config.seed,
            tag="explain",
        )

    def shap_of(self, rows: DataFrame) -> DataFrame:
        return explain.tree_shap(self._finalist_model, rows, self.tree_columns, models.ID)

    @cached_property
    def shap(self) -> DataFrame:
        """Attributions of every test row."""
        return materialize(self.shap_of(self.model_rows.where("split = 'test'")), "shap")

    def shap_importance(self) -> DataFrame:
        unit = explain.attribution_unit(self._finalist_model)
        return explain.shap_importance(self.shap, unit)

    # --- text ---------------------------------------------------------------------------------

    def reviews(self) -> DataFrame:
        source = self._reviews() if self._reviews else self.tables["reviews"]
        return sentiment.with_review_text(source)

    @cached_property
    def text_scores(self) -> DataFrame:
        labelled = self.reviews().where("has_text = 1")
        with persisted(sentiment.word_table(labelled)) as rows:
            scored = sentiment.cross_fit(rows, self.config.text_folds, self.config.seed)
            return materialize(scored.drop("counts"), "text-scores")

    def sentiment_table(self) -> DataFrame:
        return sentiment.sentiment_table(self.reviews(), self.text_scores)
