"""Physical plans: what is read, what is moved, and what must never appear."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from secondcart.operators import cohort, metrics, sampling
from secondcart.operators.order_stats import running_totals
from secondcart.plans import queries
from secondcart.sources import warehouse


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def simple_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    """Joins as they are planned for large tables."""
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


@pytest.fixture
def fixed_partitions(spark):
    """Shuffle partitions are not merged, though the test data are tiny."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


CHEAP = [
    "source_profile", "delivered_orders", "orders_with_customer", "first_order", "days_since_first",
    "repurchase_gap", "cohort_funnel", "first_order_value", "first_item_category", "latest_review",
    "first_order_review", "events_cohort_funnel", "review_text",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_join_and_no_python(spark, folder, shuffled_joins, name):
    plan = simple_plan(queries.all_queries()[name](spark, folder))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                 "MapInPandas"):
        assert node not in plan


def test_filter_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(queries.delivered_orders(spark, folder))
    assert "EqualTo(o_orderstatus,F)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_totalprice" not in schema and "o_orderpriority" not in schema


def test_days_of_a_person_are_combined_before_the_shuffle(spark, folder, shuffled_joins):
    s = queries.study(spark, folder)
    plan = simple_plan(
        cohort.first_and_repeat(
            s.delivered(), "customer_unique_id", "order_purchase_timestamp", "order_id"
        )
    )
    # Read bottom-up: partial aggregation, exchange on person and day, final, exchange on person.
    window = plan.index("Window")
    partial = plan.index("partial_min")
    exchanges = [m.start() for m in re.finditer(r"Exchange hashpartitioning\(customer_unique_id", plan)]
    assert len(exchanges) == 2
    assert window < exchanges[0] < exchanges[1] < partial


def test_split_and_folds_move_no_data(spark, folder):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"))
    split = sampling.stratified_split(rows, "k", "y", 0.2, 42)
    folds = sampling.stratified_folds(split, "k", "y", 5, 42, within=F.col("split") == "train")
    assert "Exchange" not in simple_plan(folds)


def test_many_distinct_scores_do_not_meet_in_one_task(spark, fixed_partitions):
    scores = spark.range(20_000).select(
        F.lit("m").alias("model"), F.col("id"), (F.col("id") % 2).cast("int").alias("label"),
        (F.xxhash64("id") / F.lit(2.0**63)).alias("score"),
    )
    counted = metrics.score_counts(scores, ["model"])
    totals = {"tp": F.col("pos")}
    bucketed = running_totals(counted, ["model"], "score", totals, True, rows_per_window=1000)
    plan = simple_plan(bucketed)
    assert "_bucket" in plan
    # The only window without a bucket in its key runs over the bucket totals.
    sizes = bucketed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 12_000


def test_draws_are_counted_before_they_are_shuffled(spark):
    scores = spark.range(200).select(
        F.lit("m").alias("model"), "id", (F.col("id") % 2).cast("int").alias("label"),
        (F.col("id") % 10 / 10).alias("score"),
    )
    plan = simple_plan(metrics.bootstrap_metrics(scores, "id", 5, 42))
    made = plan.index("Generate inline")
    counted = max(i for i in (m.start() for m in re.finditer("partial_sum", plan)) if i < made)
    assert "Exchange" not in plan[counted:made]


def test_text_is_not_shuffled_for_the_ratings(spark, folder, shuffled_joins):
    plan = plan_of(warehouse.document_ratings(spark, folder))
    for block in plan.split("\n\n"):
        if "Exchange" in block.split("\n")[0]:
            assert not re.search(r"\btext#", block)


def test_each_order_source_is_shuffled_once(spark, folder, shuffled_joins):
    plan = simple_plan(queries.new_study(spark, folder).first_order_features())
    on_order = re.findall(r"Exchange hashpartitioning\(order_id#\d+L?, \d+\)", plan)
    # The sample, payments, items and reviews.
    assert len(on_order) == 4
