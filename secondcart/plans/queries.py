"""Named queries over a warehouse folder: one per operator of the package.

Each takes ``(spark, folder)`` and reads whole tables. Queries of one session and folder share a
:class:`Study`, so tables it has written and models it has fitted are used again, until a table of
the folder is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secondcart.config import Config
from secondcart.functions.binning import cut_right, label_of
from secondcart.functions.hashing import hash32
from secondcart.functions.lookups import (
    DELIVERY_EDGES,
    DELIVERY_LABELS,
    POLARITY_NAMES,
    QUARTILE_LABELS,
)
from secondcart.operators import (
    cohort,
    describe,
    features,
    inference,
    metrics,
    models,
    quality,
    sampling,
    sentiment,
)
from secondcart.operators.log_ratio import scores_of_grams, word_buckets
from secondcart.operators.order_stats import exact_quantiles
from secondcart.plans.study import Study
from secondcart.sources import warehouse
from secondcart.sources.checkpoints import content_manifest, read_checkpoint, write_checkpoint
from secondcart.sources.readers import read_csv
from secondcart.sources.writers import new_path, write_table

# All rows, folds, replicates, trials and trees.
QUERY_CONFIG = Config()
EVENTS_HORIZON_DAYS = 7
GOLDEN_TOLERANCE = 0.0006
WAREHOUSE_ITEM_ORDER = ("order_item_id", "product_id", "tie_supplier", "tie_price")

ID = models.ID
Query = Callable[[SparkSession, str], DataFrame]

_studies: dict[tuple[str, ...], Study] = {}
_registry: dict[str, Query] = {}


def study(spark: SparkSession, folder: str) -> Study:
    key = (spark.sparkContext.applicationId, folder, warehouse.folder_state(spark, folder))
    if key not in _studies:
        _studies[key] = new_study(spark, folder)
    return _studies[key]


def new_study(spark: SparkSession, folder: str, config: Config = QUERY_CONFIG) -> Study:
    return Study(
        warehouse.logical_tables(spark, folder, config.seed),
        config,
        durability=warehouse.PART_TYPE_DURABILITY,
        item_order=WAREHOUSE_ITEM_ORDER,
        reviews=lambda: warehouse.document_reviews(spark, folder),
        delivered_status=warehouse.DELIVERED_STATUS,
    )


def query(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, decimals) for c in doubles})


# --- cohort -----------------------------------------------------------------------------------


@query
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return describe.table_counts(study(spark, folder).tables)


@query
def source_profile(spark: SparkSession, folder: str) -> DataFrame:
    return describe.source_profile(
        study(spark, folder).delivered(), ID, "order_purchase_timestamp"
    )


@query
def delivered_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = study(spark, folder).tables["orders"]
    return cohort.delivered_orders(orders, warehouse.DELIVERED_STATUS).select(
        "order_id", "customer_id", "order_purchase_timestamp"
    )


@query
def orders_with_customer(spark: SparkSession, folder: str) -> DataFrame:
    tables = study(spark, folder).tables
    return cohort.orders_with_customer(tables["orders"], tables["customers"]).select(
        "order_id", "order_status", ID, "customer_state"
    )


@query
def first_order(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.first_event(
        study(spark, folder).delivered(), ID, "order_purchase_timestamp", "order_id",
        ("order_delivered_customer_date", "customer_state"),
    )


@query
def days_since_first(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.days_since_first(
        study(spark, folder).delivered(), ID, "order_purchase_timestamp"
    ).select("order_id", ID, "first_day", "days_since_first")


@query
def repurchase_gap(spark: SparkSession, folder: str) -> DataFrame:
    return (
        study(spark, folder).cohort().where("days_to_repeat is not null")
        .select(ID, "days_to_repeat", "repeat_ts")
    )


@query
def eligible_customers(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).cohort().where("eligible").select(ID, "first_day")


@query
def excluded_before_delivery(spark: SparkSession, folder: str) -> DataFrame:
    return (
        study(spark, folder).cohort().where("eligible and repeat_known").select(ID, "repeat_ts")
    )


@query
def repurchase_target(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.sample_of(study(spark, folder).cohort()).select(ID, "target")


@query
def cohort_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort_funnel(study(spark, folder).cohort())


@query
def split_cart_customers(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.split_cart_customers(study(spark, folder).cohort())


@query
def median_days_to_repurchase(spark: SparkSession, folder: str) -> DataFrame:
    positives = study(spark, folder).features.where("target = 1")
    return exact_quantiles(positives, "days_to_repeat", [0.5]).select(
        F.col("quantiles")[0].alias("median_days")
    )


@query
def events_cohort_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """The same cohort over another history: purchase events, without a delivery date."""
    purchases = warehouse.purchases(spark, folder)
    return cohort.cohort_funnel(
        cohort.build_cohort(purchases, "user_id", "ts", "event_id", EVENTS_HORIZON_DAYS)
    )


# --- features ---------------------------------------------------------------------------------


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.sample_of(study(spark, folder).cohort())


@query
def first_order_value(spark: SparkSession, folder: str) -> DataFrame:
    totals = features.total_per(
        study(spark, folder).tables["payments"], "order_id", "payment_value", "first_value"
    )
    joined = _sample(spark, folder).join(totals, "order_id", "left")
    return joined.select(
        ID, F.round(F.coalesce("first_value", F.lit(0.0)), 6).alias("first_value")
    )


@query
def first_order_freight(spark: SparkSession, folder: str) -> DataFrame:
    totals = features.total_per(
        study(spark, folder).tables["items"], "order_id", "freight_value", "first_freight"
    )
    return _sample(spark, folder).join(totals, "order_id", "left").select(
        ID, F.round("first_freight", 6).alias("first_freight")
    )


@query
def first_item_category(spark: SparkSession, folder: str) -> DataFrame:
    tables = study(spark, folder).tables
    first = features.first_items(tables["items"], WAREHOUSE_ITEM_ORDER)
    joined = _sample(spark, folder).join(first, "order_id", "left")
    return features.with_category(joined, tables["products"], tables["category"]).select(
        ID, "order_id", "product_id", "category"
    )


@query
def durability_flag(spark: SparkSession, folder: str) -> DataFrame:
    flag = features.map_flag(F.col("category"), warehouse.PART_TYPE_DURABILITY)
    return study(spark, folder).features.select(ID, "category", flag.alias("durable"))


@query
def latest_review(spark: SparkSession, folder: str) -> DataFrame:
    return features.latest_reviews(study(spark, folder).tables["sentiment"])


@query
def first_order_review(spark: SparkSession, folder: str) -> DataFrame:
    reviews = features.latest_reviews(study(spark, folder).tables["sentiment"])
    return _sample(spark, folder).join(reviews, "order_id", "left").select(
        ID, "review_id", "review_score", "has_text", "prob_neg", "prob_pos"
    )


@query
def delivery_slack_days(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).select(ID, features.delivery_slack_days().alias("slack_days"))


@query
def posting_days(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).select(ID, features.posting_days().alias("posting_days"))


@query
def purchase_month(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder).select(
        ID, F.month("order_purchase_timestamp").alias("purchase_month")
    )


@query
def late_flag(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).imputed().select(ID, "slack_days", "late_flag")


@query
def state_group(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).imputed().select(ID, "state", "state_group")


@query
def state_code(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).modeling_base().select(ID, "state_code")


@query
def imputed_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        study(spark, folder).imputed().select(
            ID, "first_value", "slack_days", "rating", "has_text", "sent_neg", "sent_pos",
            "durable",
        )
    )


@query
def net_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).imputed().select(
        ID, F.round(features.net_sentiment(), 6).alias("net_sentiment")
    )


@query
def modeling_base(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table from the sources to the end, nothing used again."""
    return rounded(new_study(spark, folder).modeling_base())


@query
def mapping_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return features.mapping_coverage(
        study(spark, folder).features, warehouse.PART_TYPE_DURABILITY
    )


@query
def missingness_report(spark: SparkSession, folder: str) -> DataFrame:
    return features.missingness_report(
        study(spark, folder).features, warehouse.PART_TYPE_DURABILITY
    )


@query
def dq_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of each rule; all are 0."""
    s = study(spark, folder)
    without_person = quality.not_null_violations(s.delivered(), [ID])
    per_person = s.features.groupBy(ID).agg(F.count("*").alias("n"))
    decoded = s.base.where(F.col("state_code").isNull())
    rules = [
        without_person.select(F.lit("orders without person").alias("rule"), F.col(ID).alias("n")),
        per_person.agg(
            F.lit("repeated persons").alias("rule"), F.count_if(F.col("n") > 1).alias("n")
        ),
        s.features.agg(
            F.lit("rows lost or repeated by joins").alias("rule"),
            F.abs(F.count("*") - _sample(spark, folder).agg(F.count("*")).scalar()).alias("n"),
        ),
        decoded.agg(F.lit("codes without level").alias("rule"), F.count("*").alias("n")),
    ]
    result = rules[0]
    for rule in rules[1:]:
        result = result.unionByName(rule)
    return result


# --- CSV sources ------------------------------------------------------------------------------


def _by_way_of_csv(table: DataFrame, name: str) -> DataFrame:
    """The table written as CSV and read again with its declared schema."""
    path = new_path(table.sparkSession, name)
    write_table(table, path, "csv")
    return read_csv(table.sparkSession, path, table.schema, multiline_text=True)


@query
def csv_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders from CSV: declared types and named timestamps."""
    return _by_way_of_csv(study(spark, folder).tables["orders"], "csv-orders")


@query
def csv_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews from CSV: quoted fields that span lines, whole texts."""
    reviews = warehouse.document_reviews(spark, folder).drop("review_creation_date")
    return _by_way_of_csv(reviews, "csv-reviews")


@query
def checkpoint_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written with a manifest and read back through its check: what the manifest holds."""
    path = new_path(spark, "checkpoint")
    write_checkpoint(study(spark, folder).tables["orders"], path)
    return content_manifest(read_checkpoint(spark, path)).select(
        "n_rows", F.array_join("n_nulls", ",").alias("n_nulls"), "content_hash"
    )


@query
def golden_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Payments per order from CSV against the same from the source, within a tolerance."""
    payments = study(spark, folder).tables["payments"]
    totals = [
        features.total_per(table, "order_id", "payment_value", "total")
        for table in (_by_way_of_csv(payments, "csv-payments"), payments)
    ]
    return rounded(quality.golden_differences(*totals, "order_id", "total", GOLDEN_TOLERANCE))


# --- descriptive statistics -------------------------------------------------------------------


@query
def rate_by_rating(spark: SparkSession, folder: str) -> DataFrame:
    return describe.rate_by(study(spark, folder).base, "rating")


@query
def rate_by_durability(spark: SparkSession, folder: str) -> DataFrame:
    return describe.rate_by(study(spark, folder).base, "durable")


@query
def rate_by_delivery_bin(spark: SparkSession, folder: str) -> DataFrame:
    return describe.rate_by_bin(
        study(spark, folder).base, cut_right(F.col("slack_days"), DELIVERY_EDGES), DELIVERY_LABELS
    )


@query
def rate_by_value_quartile(spark: SparkSession, folder: str) -> DataFrame:
    return describe.rate_by_quantile(study(spark, folder).base, "first_value", QUARTILE_LABELS)


@query
def candidate_screen(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return describe.screen_candidates(
        s.base, ["first_freight", "posting_days"], s.config.screen_min_range
    )


@query
def two_proportion_tests(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).proportion_tests()


@query
def state_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return describe.frequency(study(spark, folder).features, "state")


@query
def reference_level(spark: SparkSession, folder: str) -> DataFrame:
    return describe.mode(study(spark, folder).base, "state_group")


# --- sampling ---------------------------------------------------------------------------------


@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).rows.select(ID, "target", "split")


@query
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).rows.where("split = 'train'").select(ID, "target", "fold")


@query
def explain_sample(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return sampling.hash_sample(
        s.rows.where("split = 'test'"), ID, s.config.explain_rows, s.config.seed, "explain"
    ).select(ID)


@query
def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).rows.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum("target").cast("bigint").alias("positives"),
        F.round(F.avg("target"), 6).alias("prevalence"),
    )


@query
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.class_weights(study(spark, folder).rows.where("split = 'train'")))


@query
def winsor_limits(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    train = s.rows.where("split = 'train'")
    return rounded(
        inference.winsor_limits(train, "slack_days", s.config.clip_low, s.config.clip_high)
    )


# --- metrics, on scores that depend only on keys and outcomes ---------------------------------


def _scores(rows: DataFrame, seed: int) -> DataFrame:
    """Two score columns per row, made of a hash of the key and the outcome, in long form."""

    def blend(tag: str, boost: int) -> Column:
        return (hash32(seed, tag, ID) % 1000 + boost * F.col("target")) / F.lit(1000.0 + boost)

    scored = F.array(
        F.struct(F.lit("strong").alias("model"), blend("score", 200).alias("score")),
        F.struct(F.lit("weak").alias("model"), blend("score_b", 100).alias("score")),
    )
    keep = [c for c in ("split",) if c in rows.columns]
    return rows.select(ID, F.col("target").alias("label"), *keep, F.inline(scored))


def _all_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return _scores(s.rows, s.config.seed)


def _split_scores(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return _all_scores(spark, folder).where(F.col("split") == split)


@query
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.roc_auc(_all_scores(spark, folder)))


@query
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.average_precision(_all_scores(spark, folder)))


@query
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.roc_curve(_all_scores(spark, folder)))


@query
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.pr_curve(_all_scores(spark, folder)))


@query
def f1_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.f1_threshold(_split_scores(spark, folder, "train")))


@query
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    limits = metrics.f1_threshold(_split_scores(spark, folder, "train"))
    return rounded(metrics.confusion(_split_scores(spark, folder, "test"), limits))


@query
def threshold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    limits = metrics.f1_threshold(_split_scores(spark, folder, "train"))
    return rounded(metrics.threshold_metrics(_split_scores(spark, folder, "test"), limits))


@query
def lift_top_decile(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return rounded(
        metrics.lift_top(
            _split_scores(spark, folder, "test"), ID, s.config.top_fraction, s.config.seed
        )
    )


def _replicates(spark: SparkSession, folder: str) -> DataFrame:
    c = study(spark, folder).config
    return metrics.bootstrap_metrics(
        _split_scores(spark, folder, "test"), ID, c.bootstrap_replicates, c.seed
    )


@query
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.bootstrap_ci(_replicates(spark, folder)))


@query
def paired_bootstrap_diff(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.paired_bootstrap_diff(_replicates(spark, folder), "strong", "weak"))


@query
def cross_validated_ap(spark: SparkSession, folder: str) -> DataFrame:
    """Average precision per fold, its mean and spread, on the key-dependent scores."""
    s = study(spark, folder)
    train = s.rows.where("split = 'train'")
    folds = train.select(ID, "fold")
    by_fold = metrics.average_precision(
        _scores(train, s.config.seed).join(folds, ID), ("model", "fold")
    )
    return rounded(models.ablation_summary(by_fold, full="strong"))


@query
def finalist(spark: SparkSession, folder: str) -> DataFrame:
    ap = metrics.average_precision(_split_scores(spark, folder, "train"))
    return rounded(models.finalist(ap.withColumnRenamed("ap", "cv_ap")))


@query
def spearman_corr(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    columns = ["first_value", "slack_days", "sent_neg", "rating"]
    long = s.base.select(
        (hash32(s.config.seed, "score", ID) % 1000 + 200 * F.col("target")).alias("score"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        ),
    )
    return rounded(metrics.spearman(long, "value", "score", ["feature"]))


@query
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report on a prediction that keeps about three labels in four."""
    s = study(spark, folder)
    h = hash32(s.config.seed, "pred", "review_id")
    predicted = s.reviews().where("has_text = 1").select(
        "label", F.when(h % 4 == 0, h % 3).otherwise(F.col("label")).cast("int").alias("prediction")
    )
    return rounded(metrics.classification_report(predicted, POLARITY_NAMES))


# --- inference --------------------------------------------------------------------------------


@query
def linear_design_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The design matrix in long form: person, term, value."""
    s = study(spark, folder)
    return rounded(s.design().unpivot(ID, s.spec.columns(), "term", "value"))


@query
def linear_design_separate_text(spark: SparkSession, folder: str) -> DataFrame:
    """Column sums of the other specification, with three text columns."""
    s = study(spark, folder)
    columns = s.spec.columns(inference.SEPARATE_TEXT)
    design = s.design(text=inference.SEPARATE_TEXT)
    sums = design.agg(*[F.sum(c).alias(c) for c in columns])
    long = F.inline(
        F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("total")) for c in columns])
    )
    return rounded(sums.select(long), 4)


@query
def logit_inference(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(study(spark, folder).logit_table(), 4)


@query
def logit_fit_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return rounded(inference.fit_stats(s.logit, s.design("train")), 4)


@query
def logit_test_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(study(spark, folder).logit_scores()), 4)


@query
def block_lr_test(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return rounded(inference.block_lr_test(s.logit, s.design("train"), s.spec.columns()), 4)


@query
def vif(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return rounded(inference.vif(s.design("train"), s.spec.columns()), 4)


@query
def vif_three_terms(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        inference.vif(study(spark, folder).design("train"), ["slack_days", "late_flag", "rating"]),
        4,
    )


def _state_columns(s: Study) -> list[str]:
    return [c for c in s.spec.columns() if c.startswith(inference.STATE_PREFIX)]


@query
def logit_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Regression on the state dummies alone, whose estimates have a closed form."""
    s = study(spark, folder)
    design, columns = s.design("train"), _state_columns(s)
    table = inference.logit_table(inference.fit_logit(design, columns), design, columns)
    return rounded(table.drop("vif"), 4)


@query
def state_block_test(spark: SparkSession, folder: str) -> DataFrame:
    """Likelihood-ratio test of the state dummies alone."""
    s = study(spark, folder)
    design, columns = s.design("train"), _state_columns(s)
    fitted = inference.fit_logit(design, columns)
    stats = inference.fit_stats(fitted, design)
    return rounded(
        stats.select(
            (2 * (F.col("log_likelihood") - F.col("null_log_likelihood"))).alias("chi_square"),
            F.lit(len(columns)).alias("degrees_of_freedom"),
            "pseudo_r2",
        ),
        4,
    )


# --- models -----------------------------------------------------------------------------------


def _base_scores_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return study(spark, folder).base_scores.where(F.col("model") == name)


@query
def base_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(study(spark, folder).base_scores), 4)


@query
def lr_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _base_scores_of(spark, folder, "logistic (base)")


@query
def rf_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _base_scores_of(spark, folder, "random forest (base)")


@query
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _base_scores_of(spark, folder, "boosting (base)")


@query
def gbt_deep_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _base_scores_of(spark, folder, "deep boosting (base)")


@query
def hp_search(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return models.search_table(s.searches, s.base)


@query
def hp_table(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return models.hp_table(s.searches, s.base)


@query
def oof_scores(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).final_oof


@query
def cv_average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.cv_average_precision(study(spark, folder).final_oof), 4)


@query
def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(study(spark, folder).metrics(), 4)


@query
def base_vs_tuned(spark: SparkSession, folder: str) -> DataFrame:
    s = study(spark, folder)
    return rounded(models.base_vs_tuned(s.base_scores, s.final_scores), 4)


@query
def ablation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.ablation_summary(study(spark, folder).ablation_folds), 4)


@query
def shap_importance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(study(spark, folder).shap_importance(), 4)


# --- text -------------------------------------------------------------------------------------


@query
def review_text(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).reviews().select("review_id", "text", "has_text")


@query
def polarity_label(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).reviews().select("review_id", "review_score", "label")


@query
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    with_text = study(spark, folder).reviews().where("has_text = 1")
    named = with_text.select(label_of(F.col("label"), POLARITY_NAMES).alias("label"))
    return describe.frequency(named, "label")


@query
def text_folds(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).text_scores.select("review_id", "label", "fold")


@query
def log_ratio_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold scores of all texts by log counts of hashed words and word pairs."""
    config = study(spark, folder).config
    rated = warehouse.document_ratings(spark, folder).where("has_text = 1").select(
        F.col("doc_id").alias("review_id"),
        sentiment.polarity_label(F.col("review_score")).alias("label"),
    )
    folded = sampling.stratified_folds(
        rated, "review_id", "label", config.text_folds, config.seed, tag="text"
    )
    texts = warehouse.document_texts(spark, folder)
    words = texts.select("review_id", word_buckets(F.col("text")).alias("words"))
    # Texts become buckets in the scan. Labels grow with the texts, so they are not broadcast.
    hashed = words.join(folded.hint("merge"), "review_id")
    return scores_of_grams(hashed).drop("prob_neg", "prob_neu", "prob_pos")


@query
def sentiment_oof(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).text_scores.select(
        "review_id", "label", "fold", "prob_neg", "prob_neu", "prob_pos", "prediction"
    )


@query
def sentiment_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        metrics.classification_report(study(spark, folder).text_scores, POLARITY_NAMES), 4
    )


@query
def sentiment_table(spark: SparkSession, folder: str) -> DataFrame:
    return study(spark, folder).sentiment_table()


@query
def sentiment_layout(spark: SparkSession, folder: str) -> DataFrame:
    """What the output table holds beside the probabilities."""
    table = study(spark, folder).sentiment_table()
    return table.select(
        "review_id", "order_id", "review_score", "has_text", "fold",
        F.col("prob_pos").isNotNull().alias("scored"),
        F.abs(F.col("prob_neg") + F.col("prob_neu") + F.col("prob_pos") - 1).alias("gap"),
    ).withColumn("gap", F.coalesce(F.round("gap", 6), F.lit(0.0)))
