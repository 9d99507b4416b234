"""Features of the first order, and the modelling base."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.functions.binning import label_of
from secondcart.functions.dates import elapsed_days_floor
from secondcart.functions.lookups import CATEGORY_DURABILITY, TREE_FEATURES, lookup
from secondcart.operators.order_stats import exact_quantiles_of

OTHER_STATES = "OTHER"

# Values used where a feature is missing.
IMPUTED_CONSTANTS = {
    "first_value": 0.0,
    "rating": 5.0,
    "has_text": 0,
    "sent_neg": 0.0,
    "sent_pos": 0.0,
}
DEFAULT_DURABLE = 1


def total_per(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum per key; a key with only missing values sums to 0."""
    return df.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))


def first_items(items: DataFrame, item_order: Sequence[str]) -> DataFrame:
    """First item of each order by item number (plus tie-breaks that make the order total)."""
    first = items.groupBy("order_id").agg(F.min(F.struct(*item_order)).alias("first"))
    return first.select("order_id", F.col("first.product_id").alias("product_id"))


def order_item_summary(items: DataFrame, item_order: Sequence[str]) -> DataFrame:
    """Freight total and first item of each order, in one shuffle of the items."""
    return (
        items.groupBy("order_id")
        .agg(
            F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("first_freight"),
            F.min(F.struct(*item_order)).alias("first"),
        )
        .select("order_id", "first_freight", F.col("first.product_id").alias("product_id"))
    )


def product_categories(products: DataFrame, category: DataFrame) -> DataFrame:
    """Translated category of every product. Joined here, where rows are narrow and few, and not
    on the sample, which would be shuffled once more."""
    return (
        products.select("product_id", "product_category_name")
        .join(category, "product_category_name", "left")
        .select("product_id", F.col("product_category_name_english").alias("category"))
    )


def with_category(first: DataFrame, products: DataFrame, category: DataFrame) -> DataFrame:
    """Adds the translated product category of ``product_id``."""
    return first.join(product_categories(products, category), "product_id", "left")


def map_flag(
    category: Column,
    mapping: Mapping[str, int] = CATEGORY_DURABILITY,
    default: int = DEFAULT_DURABLE,
) -> Column:
    """0/1 flag of a category; unknown and unmapped categories get ``default``."""
    return lookup(category, dict(mapping), default).cast("int")


def latest_per(df: DataFrame, key: str, ts: str, tie: str, carry: Sequence[str]) -> DataFrame:
    """Last row per key by time; a missing time counts as last, ties go to the largest ``tie``."""
    last = F.max(F.struct(F.col(ts).isNull().alias("_undated"), ts, tie, *carry))
    return df.groupBy(key).agg(last.alias("last")).select(
        key, "last." + tie, "last." + ts, *[f"last.{c}" for c in carry]
    )


REVIEW_COLUMNS = ("review_score", "has_text", "prob_neg", "prob_pos")


def latest_reviews(sentiment: DataFrame) -> DataFrame:
    return latest_per(sentiment, "order_id", "review_creation_date", "review_id", REVIEW_COLUMNS)


def delivery_slack_days() -> Column:
    """Days of advance over the promised date; negative when late, NULL without delivery."""
    return elapsed_days_floor(
        F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date")
    )


def posting_days() -> Column:
    """Days from approval to hand-over to the carrier."""
    return elapsed_days_floor(F.col("order_delivered_carrier_date"), F.col("order_approved_at"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by name."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.desc("count"), column)
        .limit(k)
    )


def top_k_group(df: DataFrame, column: str, k: int, other: str) -> Column:
    """The value itself when it is one of the ``k`` most frequent in ``df``, else ``other``."""
    top = top_values(df, column, k).agg(F.collect_set(column)).scalar()
    return F.when(F.array_contains(top, F.col(column)), F.col(column)).otherwise(F.lit(other))


def alpha_code(df: DataFrame, column: str, max_levels: int = 1000) -> Column:
    """Position of a level in the alphabetical order of the levels of ``df``, from 0.

    More than ``max_levels`` levels are an error: the level list is held by every task.
    """
    levels = df.select(column).distinct().limit(max_levels + 1)
    all_levels = F.collect_set(column)
    checked = F.when(F.size(all_levels) <= max_levels, F.sort_array(all_levels)).otherwise(
        F.raise_error(F.lit(f"{column} has more than {max_levels} levels"))
    )
    return (F.array_position(levels.agg(checked).scalar(), F.col(column)) - 1).cast("int")


def median(df: DataFrame, column: str) -> Column:
    """Exact median, as a literal."""
    return F.lit(exact_quantiles_of(df, {column: [0.5]})[column][0]).cast("double")


# Order ids (a few bytes each) up to this many are broadcast to prune the sources.
BROADCAST_ORDERS = 1_000_000


def of_sample(source: DataFrame, orders: DataFrame | None) -> DataFrame:
    """Rows of the sample's orders only, dropped in the scan's own tasks. Without ``orders`` all
    rows stay: a join that shuffles the raw source would cost more than it saves, since partial
    aggregation already leaves one row per order and task."""
    if orders is None:
        return source
    return source.join(F.broadcast(orders), "order_id", "left_semi")


def first_order_features(
    sample: DataFrame, tables: Mapping[str, DataFrame], item_order: Sequence[str]
) -> DataFrame:
    """Everything known about the first order, before imputation.

    Each source is reduced to one row per order before it is joined, all on ``order_id``, so the
    sample is shuffled once for the three joins and once more for the product. If the sample has
    few orders, other orders' rows are dropped before anything is aggregated.
    """
    orders = sample.select("order_id")
    if orders.count() > BROADCAST_ORDERS:
        orders = None
    payments = total_per(
        of_sample(tables["payments"], orders), "order_id", "payment_value", "first_value"
    )
    items = order_item_summary(of_sample(tables["items"], orders), item_order)
    reviews = latest_reviews(of_sample(tables["sentiment"], orders)).select(
        "order_id",
        F.col("review_score").cast("double").alias("rating"),
        "has_text",
        F.col("prob_neg").alias("sent_neg"),
        F.col("prob_pos").alias("sent_pos"),
    )
    joined = (
        sample.join(payments, "order_id", "left")
        .join(items, "order_id", "left")
        .join(reviews, "order_id", "left")
    )
    return with_category(joined, tables["products"], tables["category"]).select(
        "customer_unique_id",
        "order_id",
        "target",
        "days_to_repeat",
        F.col("customer_state").alias("state"),
        F.month("order_purchase_timestamp").alias("purchase_month"),
        delivery_slack_days().cast("double").alias("slack_days"),
        posting_days().cast("double").alias("posting_days"),
        "first_value",
        "first_freight",
        "category",
        "rating",
        "has_text",
        "sent_neg",
        "sent_pos",
    )


def imputed_features(
    features: DataFrame,
    top_states: int,
    durability: Mapping[str, int] = CATEGORY_DURABILITY,
) -> DataFrame:
    """Fills what is missing and derives flags, groups and codes.

    The slack median and the state ranking come from all rows of ``features``; the late flag is
    taken after imputation.
    """
    slack = F.coalesce(F.col("slack_days"), median(features, "slack_days"))
    grouped = features.withColumns(
        {
            "slack_days": slack,
            "durable": map_flag(F.col("category"), durability),
            "state_group": top_k_group(features, "state", top_states, OTHER_STATES),
        }
    ).fillna(IMPUTED_CONSTANTS)
    return grouped.withColumn("late_flag", (F.col("slack_days") < 0).cast("int"))


def modeling_base(imputed: DataFrame) -> DataFrame:
    """Key, target and the ten model features."""
    coded = imputed.withColumn("state_code", alpha_code(imputed, "state_group"))
    return coded.select("customer_unique_id", "target", *TREE_FEATURES)


def decode_levels(base: DataFrame, code: str, levels: Sequence[str], name: str) -> DataFrame:
    """Names of the codes of :func:`alpha_code`; an unexpected code decodes to NULL."""
    return base.withColumn(name, label_of(F.col(code), levels))


def net_sentiment() -> Column:
    """Positive minus negative probability; 0 without text."""
    return F.coalesce(F.col("sent_pos"), F.lit(0.0)) - F.coalesce(F.col("sent_neg"), F.lit(0.0))


def missingness_report(features: DataFrame, durability: Mapping[str, int]) -> DataFrame:
    """Counts of what had to be imputed, in one pass over the features before imputation."""
    mapped = lookup(F.col("category"), dict(durability))
    texts = F.coalesce(F.col("has_text"), F.lit(0))
    return features.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("slack_days").isNull()).alias("n_without_delivery"),
        F.count_if(F.col("category").isNull()).alias("n_without_category"),
        F.count_if(F.col("category").isNotNull() & mapped.isNull()).alias("n_outside_map"),
        F.count_if(F.col("rating").isNull()).alias("n_without_review"),
        F.sum(texts).cast("bigint").alias("n_with_text"),
        F.round(F.avg(texts), 6).alias("share_with_text"),
    )


def mapping_coverage(features: DataFrame, durability: Mapping[str, int]) -> DataFrame:
    """Rows per category with the state of its mapping."""
    mapped = lookup(F.col("category"), dict(durability))
    status = (
        F.when(F.col("category").isNull(), "missing")
        .when(mapped.isNull(), "unmapped")
        .otherwise("mapped")
    )
    return features.groupBy("category", status.alias("status")).agg(F.count("*").alias("n"))
