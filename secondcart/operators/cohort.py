"""Cohort building: first order, day gaps, repurchase, eligibility and outcome.

Every aggregation per person goes through one row per (person, day) first. Partial aggregation
makes those rows before the shuffle, so a person who holds a large part of all orders arrives
as at most one row per calendar day and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondcart.functions.dates import calendar_day_gap
from secondcart.operators.joins import lookup_by_hot_key


DELIVERED = "delivered"


def delivered_orders(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.where(F.col("order_status") == status)


def orders_with_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the durable person key and the state."""
    return orders.join(
        customers.select("customer_id", "customer_unique_id", "customer_state"),
        "customer_id",
        "left",
    )


def person_days(
    events: DataFrame, key: str, ts: str, tie: str, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per person and day: the first event of the day and the number of events."""
    first = F.min(F.struct(ts, tie, *carry))
    return events.groupBy(key, F.to_date(ts).alias("event_day")).agg(
        first.alias("first"), F.count("*").alias("n_events")
    )


def first_event(
    events: DataFrame, key: str, ts: str, tie: str, carry: Sequence[str] = ()
) -> DataFrame:
    """First event of each person by time, then by ``tie``."""
    first = events.groupBy(key).agg(F.min(F.struct(ts, tie, *carry)).alias("first"))
    return first.select(key, "first.*")


def days_since_first(events: DataFrame, key: str, ts: str) -> DataFrame:
    """All events, with the person's first day and the calendar days since then."""
    first = events.groupBy(key).agg(
        F.min(F.to_date(ts)).alias("first_day"), F.count("*").alias("n_events")
    )
    return (
        lookup_by_hot_key(events, first, key, weight="n_events")
        .drop("n_events")
        .withColumn("days_since_first", calendar_day_gap(F.col(ts), F.col("first_day")))
    )


def first_and_repeat(
    events: DataFrame, key: str, ts: str, tie: str, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per person: the first event, how many events its day had, and the earliest event
    on any later day.

    The second distinct day of a person is the day of the repeat, so two rows per person decide
    everything.
    """
    by_day = Window.partitionBy(key).orderBy("event_day")
    return (
        person_days(events, key, ts, tie, carry)
        .select(
            key,
            "event_day",
            "first",
            "n_events",
            F.row_number().over(by_day).alias("nth_day"),
            F.lead("event_day").over(by_day).alias("repeat_day"),
            F.lead(F.col("first")[ts]).over(by_day).alias("repeat_ts"),
        )
        .where(F.col("nth_day") == 1)
        .select(
            key,
            "first.*",
            F.col("event_day").alias("first_day"),
            F.col("n_events").alias("first_day_events"),
            F.datediff("repeat_day", "event_day").alias("days_to_repeat"),
            "repeat_ts",
        )
    )


def build_cohort(
    events: DataFrame,
    key: str,
    ts: str,
    tie: str,
    horizon_days: int,
    known_at: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The population with its eligibility, exclusion and outcome columns.

    * ``eligible``: the first day leaves at least ``horizon_days`` of observation (the bound is
      the day of the last event of all).
    * ``repeat_known``: the repeat happened strictly before ``known_at``, the moment from which
      the outcome is to be predicted. Unknown moments keep the person.
    * ``target``: a repeat within ``horizon_days``, counting the last day.
    * ``in_sample``: eligible and not known before.
    """
    last = events.agg(F.max(ts)).scalar()
    known = F.lit(False)
    if known_at is not None:
        known = F.coalesce(F.col("repeat_ts") < known_at, F.lit(False))
    return (
        first_and_repeat(events, key, ts, tie, carry)
        .withColumns(
            {
                "eligible": F.col("first_day") <= F.date_sub(F.to_date(last), horizon_days),
                "repeat_known": known,
                "target": F.coalesce(F.col("days_to_repeat") <= horizon_days, F.lit(False)).cast(
                    "int"
                ),
            }
        )
        .withColumn("in_sample", F.col("eligible") & ~F.col("repeat_known"))
    )


ORDER_COLUMNS = (
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "customer_state",
)


def purchase_cohort(delivered: DataFrame, horizon_days: int) -> DataFrame:
    """Cohort over delivered orders; the outcome is known from the delivery of the first order,
    or from the promised day when the delivery date is missing."""
    return build_cohort(
        delivered,
        key="customer_unique_id",
        ts="order_purchase_timestamp",
        tie="order_id",
        horizon_days=horizon_days,
        known_at=F.coalesce("order_delivered_customer_date", "order_estimated_delivery_date"),
        carry=ORDER_COLUMNS,
    )


def sample_of(cohort: DataFrame) -> DataFrame:
    return cohort.where("in_sample")


def cohort_funnel(cohort: DataFrame) -> DataFrame:
    """All persons, eligible, excluded, sample, positives and their share, in one pass."""
    positives = F.count_if(F.col("in_sample") & (F.col("target") == 1))
    sample = F.count_if("in_sample")
    return cohort.agg(
        F.count("*").alias("n_customers"),
        F.count_if("eligible").alias("n_eligible"),
        F.count_if(~F.col("eligible")).alias("n_without_window"),
        F.count_if(F.col("eligible") & F.col("repeat_known")).alias("n_known_before"),
        sample.alias("n_sample"),
        positives.alias("n_positive"),
        F.round(positives / sample, 6).alias("positive_rate"),
    )


def split_cart_customers(cohort: DataFrame) -> DataFrame:
    """Persons with more than one order on their first day."""
    return cohort.agg(F.count_if(F.col("first_day_events") > 1).alias("n_split_cart_customers"))
