"""Day arithmetic and cohort rules on hand-made orders."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from secondcart.functions.dates import elapsed_days_floor
from secondcart.operators import cohort, features

SCHEMA = (
    "customer_unique_id string, order_id string, order_purchase_timestamp timestamp_ntz,"
    " order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz,"
    " order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz,"
    " customer_state string"
)


def ts(text):
    return None if text is None else datetime.fromisoformat(text)


def order(person, order_id, bought, delivered=None, promised=None):
    bought, delivered, promised = ts(bought), ts(delivered), ts(promised)
    return (person, order_id, bought, bought, bought, delivered, promised, "SP")


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        # Last order of all: sets the observation bound to 2021-01-01, so the cut is 2020-07-05.
        order("last", "z1", "2021-01-01 10:00"),
        # 23:59 to 00:01 is one calendar day: a repurchase.
        order("midnight", "a1", "2020-01-01 23:59"),
        order("midnight", "a2", "2020-01-02 00:01"),
        # Two orders of one day are a split cart; the first is the earlier by time.
        order("split", "b2", "2020-01-01 09:00"),
        order("split", "b1", "2020-01-01 10:00"),
        # Same instant: the smaller id is first.
        order("tie", "c2", "2020-01-01 09:00"),
        order("tie", "c1", "2020-01-01 09:00"),
        # Horizon bounds.
        order("day180", "d1", "2020-01-01 09:00"),
        order("day180", "d2", "2020-06-29 09:00"),
        order("day181", "e1", "2020-01-01 09:00"),
        order("day181", "e2", "2020-06-30 09:00"),
        # On the cut and one day after it.
        order("on cut", "f1", "2020-07-05 23:00"),
        order("after cut", "g1", "2020-07-06 00:30"),
        # Bought again before the first delivery, and exactly at it.
        order("known", "h1", "2020-01-01 09:00", "2020-01-10 12:00", "2020-01-05 00:00"),
        order("known", "h2", "2020-01-10 11:59"),
        order("same moment", "i1", "2020-01-01 09:00", "2020-01-10 12:00"),
        order("same moment", "i2", "2020-01-10 12:00"),
        # Without delivery the promise counts; without both the person stays.
        order("promise", "j1", "2020-01-01 09:00", None, "2020-01-10 00:00"),
        order("promise", "j2", "2020-01-05 09:00"),
        order("nothing", "k1", "2020-01-01 09:00"),
        order("nothing", "k2", "2020-01-02 09:00"),
        # Same-day second order never counts, a later one does.
        order("split then back", "l1", "2020-01-01 09:00"),
        order("split then back", "l2", "2020-01-01 19:00"),
        order("split then back", "l3", "2020-01-04 08:00"),
    ]
    events = spark.createDataFrame(rows, SCHEMA).repartition(5)
    built = cohort.purchase_cohort(events, 180).collect()
    return {row["customer_unique_id"]: row for row in built}, events


def test_calendar_day_gap_counts_midnights(people):
    assert people[0]["midnight"]["days_to_repeat"] == 1
    assert people[0]["midnight"]["target"] == 1


def test_same_day_orders_are_not_a_repeat(people):
    rows = people[0]
    assert rows["split"]["days_to_repeat"] is None and rows["split"]["target"] == 0
    assert rows["split"]["first_day_events"] == 2
    assert rows["split then back"]["days_to_repeat"] == 3
    assert rows["split then back"]["first_day_events"] == 2


def test_first_order_by_time_then_id(people):
    assert people[0]["split"]["order_id"] == "b2"
    assert people[0]["tie"]["order_id"] == "c1"


def test_horizon_includes_its_last_day(people):
    assert people[0]["day180"]["target"] == 1
    assert people[0]["day181"]["target"] == 0
    assert people[0]["day181"]["days_to_repeat"] == 181


def test_eligibility_includes_the_cut(people):
    assert people[0]["on cut"]["eligible"]
    assert not people[0]["after cut"]["eligible"]


def test_exclusion_is_strict_and_falls_back_to_the_promise(people):
    rows = people[0]
    assert rows["known"]["repeat_known"] and not rows["known"]["in_sample"]
    assert not rows["same moment"]["repeat_known"]
    assert rows["promise"]["repeat_known"]
    assert not rows["nothing"]["repeat_known"] and rows["nothing"]["target"] == 1


def test_funnel_adds_up(people):
    rows, events = people
    funnel = cohort.cohort_funnel(cohort.purchase_cohort(events, 180)).first()
    assert funnel["n_customers"] == len(rows)
    assert funnel["n_eligible"] + funnel["n_without_window"] == funnel["n_customers"]
    assert funnel["n_sample"] == funnel["n_eligible"] - funnel["n_known_before"]
    assert cohort.split_cart_customers(cohort.purchase_cohort(events, 180)).first()[0] == 3


def test_later_orders_do_not_change_the_first(people, spark):
    rows, events = people
    extra = spark.createDataFrame([order("tie", "zz", "2020-12-31 09:00")], SCHEMA)
    again = cohort.purchase_cohort(events.unionByName(extra), 180)
    row = again.where("customer_unique_id = 'tie'").first()
    assert row["order_id"] == rows["tie"]["order_id"]
    assert row["order_purchase_timestamp"] == rows["tie"]["order_purchase_timestamp"]


def test_a_person_with_a_third_of_all_orders(spark):
    """One key holds a third of the rows; results equal those of the plain definition."""
    n = 30_000
    events = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("person"),
        F.col("id").alias("event"),
        (
            F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(((F.col("id") * 7919) % 300).cast("int"))
        ).alias("ts"),
    )
    first = cohort.first_and_repeat(events, "person", "ts", "event").where("person = 0").first()
    assert first["first_day_events"] == n // 300
    assert first["days_to_repeat"] == 3
    gaps = cohort.days_since_first(events, "person", "ts")
    assert gaps.count() == n
    hot = gaps.where("person = 0").agg(F.count("*"), F.max("days_since_first")).first()
    assert tuple(hot) == (n // 3, 297)
    cold = gaps.where("person <> 0").agg(F.max("days_since_first")).first()
    assert cold[0] == 0


def test_elapsed_days_round_down(spark):
    rows = [
        ("2020-01-10 00:00:00", "2020-01-10 13:00:00", -1),
        ("2020-01-10 00:00:00", "2020-01-10 00:00:00", 0),
        ("2020-01-10 00:00:00", "2020-01-09 00:00:01", 0),
        ("2020-01-10 00:00:00", "2020-01-08 23:59:59", 1),
        ("2020-01-10 00:00:00", "2020-01-12 00:00:00", -2),
        ("2020-01-10 00:00:00", None, None),
    ]
    df = spark.createDataFrame([(ts(a), ts(b), e) for a, b, e in rows],
                               "a timestamp_ntz, b timestamp_ntz, expected int")
    got = df.select(elapsed_days_floor(F.col("a"), F.col("b")).alias("got"), "expected").collect()
    assert [r["got"] for r in got] == [r["expected"] for r in got]


def test_elapsed_days_ignore_the_session_time_zone(spark):
    """A zone with a clock change between the two instants must not shift the result."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.createDataFrame(
            [(ts("2018-11-10 00:00:00"), ts("2018-11-01 00:00:00"))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        assert df.select(elapsed_days_floor(F.col("a"), F.col("b"))).first()[0] == 9
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_latest_review_prefers_missing_dates_then_larger_id(spark):
    df = spark.createDataFrame(
        [
            ("o1", ts("2020-01-01"), 1, 5), ("o1", ts("2020-01-02"), 2, 4),
            ("o2", ts("2020-01-01"), 3, 3), ("o2", None, 4, 2),
            ("o3", ts("2020-01-01"), 5, 1), ("o3", ts("2020-01-01"), 6, 2),
        ],
        "order_id string, review_creation_date timestamp_ntz, review_id int, review_score int",
    )
    latest = features.latest_per(
        df, "order_id", "review_creation_date", "review_id", ["review_score"]
    )
    assert {r["order_id"]: r["review_id"] for r in latest.collect()} == {"o1": 2, "o2": 4, "o3": 6}


def test_totals_and_imputation(spark):
    payments = spark.createDataFrame([("o1", 2.0), ("o1", 3.0), ("o2", None)], "order_id string, v double")
    totals = features.total_per(payments, "order_id", "v", "total")
    assert {r["order_id"]: r["total"] for r in totals.collect()} == {"o1": 5.0, "o2": 0.0}

    raw = spark.createDataFrame(
        [
            ("p1", "o1", 0, None, "SP", 1, -3.0, 1.0, 10.0, 1.0, "food", 1.0, 1, 0.9, 0.0),
            ("p2", "o2", 1, 3, "SP", 2, None, 1.0, None, None, "art", None, None, None, None),
            ("p3", "o3", 0, None, "RJ", 3, 5.0, 1.0, 20.0, 2.0, None, 4.0, 0, None, None),
            ("p4", "o4", 0, None, None, 4, 1.0, 1.0, 20.0, 2.0, "other", 4.0, 0, None, None),
            ("p5", "o5", 0, None, "BA", 4, 0.0, 1.0, 20.0, 2.0, "art", 4.0, 0, None, None),
        ],
        "customer_unique_id string, order_id string, target int, days_to_repeat int, state string,"
        " purchase_month int, slack_days double, posting_days double, first_value double,"
        " first_freight double, category string, rating double, has_text int, sent_neg double,"
        " sent_pos double",
    )
    imputed = {r["customer_unique_id"]: r for r in features.imputed_features(raw, 2).collect()}
    assert imputed["p2"]["slack_days"] == 0.5 and imputed["p2"]["late_flag"] == 0
    assert imputed["p2"]["first_value"] == 0.0 and imputed["p2"]["first_freight"] is None
    assert imputed["p2"]["rating"] == 5.0 and imputed["p2"]["has_text"] == 0
    assert imputed["p1"]["late_flag"] == 1 and imputed["p5"]["late_flag"] == 0
    # Mapped, unmapped and missing categories; the last two count as durable.
    assert [imputed[p]["durable"] for p in ("p1", "p2", "p3", "p4")] == [0, 1, 1, 1]
    # SP is most frequent, then BA before RJ by name; RJ and the missing state go to the rest.
    assert [imputed[p]["state_group"] for p in ("p1", "p3", "p4", "p5")] == [
        "SP", "OTHER", "OTHER", "BA",
    ]
    base = features.modeling_base(features.imputed_features(raw, 2))
    codes = {r["customer_unique_id"]: r["state_code"] for r in base.collect()}
    assert codes == {"p1": 2, "p2": 2, "p3": 1, "p4": 1, "p5": 0}
    decoded = features.decode_levels(base, "state_code", ["BA", "OTHER", "SP"], "state_group")
    assert decoded.where("customer_unique_id = 'p3'").first()["state_group"] == "OTHER"
    report = features.missingness_report(raw, {"food": 0, "art": 1}).first()
    assert report["n_without_category"] == 1 and report["n_outside_map"] == 1
