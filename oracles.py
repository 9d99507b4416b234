"""DuckDB SQL for the named queries, over the warehouse tables.

Written from the definitions, independently of the Spark plans: plain windows, ``quantile_cont``,
correlated counts. Common table expressions are shared; each query takes those it needs.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase


def _h32(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def _h60(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


WHITE_SPACE = " || ".join(
    f"chr({c})"
    for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233,
              8239, 8287, 12288]
)

RATING = """CASE WHEN quality = 0 AND toxic = 1 THEN 2 WHEN quality = 0 THEN 1
    WHEN quality = 1 AND toxic = 1 THEN 3 WHEN quality = 1 THEN 5 ELSE 4 END"""

DURABLE = """CASE category WHEN 'economy' THEN 0 WHEN 'small' THEN 0 WHEN 'promo' THEN 0
    WHEN 'medium' THEN 1 WHEN 'standard' THEN 1 END"""

CTES: dict[str, str] = {
    "ord": """
        SELECT k AS order_id, o_custkey AS customer_id,
            o_orderstatus AS order_status,
            o_orderdate + to_hours(k % 24) AS order_purchase_timestamp,
            o_orderdate + to_hours(k % 24 + k % 3) AS order_approved_at,
            o_orderdate + to_hours(k % 24 + 24 + (k * 7) % 96) AS order_delivered_carrier_date,
            CASE WHEN k % 97 <> 0 THEN o_orderdate + to_hours(k % 24 + 24 * (3 + (k * 13) % 35)) END
                AS order_delivered_customer_date,
            o_orderdate + to_hours(720) AS order_estimated_delivery_date
        FROM (SELECT *, o_orderkey AS k FROM orders
              UNION ALL
              SELECT *, o_orderkey + 100000000 AS k FROM orders WHERE o_orderkey % 25 = 0)""",
    "cust": """
        SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, n_name AS customer_state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "delivered": """
        SELECT * FROM ord LEFT JOIN cust USING (customer_id) WHERE order_status = 'F'""",
    "first_o": """
        SELECT * FROM delivered
        QUALIFY row_number() OVER (PARTITION BY customer_unique_id
                                   ORDER BY order_purchase_timestamp, order_id) = 1""",
    "gaps": """
        SELECT d.*, CAST(f.order_purchase_timestamp AS DATE) AS first_day,
            date_diff('day', CAST(f.order_purchase_timestamp AS DATE),
                      CAST(d.order_purchase_timestamp AS DATE)) AS gap
        FROM delivered d
        JOIN (SELECT customer_unique_id, order_purchase_timestamp FROM first_o) f
            USING (customer_unique_id)""",
    "rep": """
        SELECT customer_unique_id, min(gap) AS days_to_repeat,
            min(order_purchase_timestamp) AS repeat_ts
        FROM gaps WHERE gap >= 1 GROUP BY 1""",
    "cohort": """
        SELECT f.*, CAST(f.order_purchase_timestamp AS DATE) AS first_day, days_to_repeat, repeat_ts,
            CAST(f.order_purchase_timestamp AS DATE)
                <= (SELECT CAST(max(order_purchase_timestamp) AS DATE) - 180 FROM delivered)
                AS eligible,
            coalesce(repeat_ts < coalesce(order_delivered_customer_date,
                                          order_estimated_delivery_date), false) AS repeat_known,
            CASE WHEN days_to_repeat <= 180 THEN 1 ELSE 0 END AS target
        FROM first_o f LEFT JOIN rep USING (customer_unique_id)""",
    "sample": "SELECT * FROM cohort WHERE eligible AND NOT repeat_known",
    "pay": """
        SELECT l_orderkey AS order_id,
            sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS first_value
        FROM lineitem GROUP BY 1""",
    "freight": """
        SELECT l_orderkey AS order_id, sum(l_extendedprice * l_tax) AS first_freight
        FROM lineitem GROUP BY 1""",
    "item": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""",
    "item_category": """
        SELECT order_id, product_id,
            lower(p_type) AS category
        FROM item LEFT JOIN part ON product_id = p_partkey""",
    "doc": f"""
        SELECT doc_id, {RATING} AS review_score,
            nullif(trim(coalesce(CASE WHEN doc_id % 2 <> 0 THEN ' ' END, '') || ' ' ||
                        coalesce(chr(10) || text || ' ', ''),
                        {WHITE_SPACE}), '') AS review_text
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "doc_label": """
        SELECT doc_id AS review_id, review_score, review_text,
            CASE WHEN review_text IS NULL THEN 0 ELSE 1 END AS has_text,
            CASE WHEN review_score <= 2 THEN 0 WHEN review_score = 3 THEN 1 ELSE 2 END AS label
        FROM doc""",
    "rev_keys": """
        SELECT o_orderkey AS order_id, 2 * o_orderkey AS review_id,
            o_orderdate + to_hours(240) AS review_creation_date
        FROM orders
        UNION ALL
        SELECT o_orderkey, 2 * o_orderkey + 1, o_orderdate + to_hours(264)
        FROM orders WHERE o_orderkey % 20 = 1""",
    "rev": f"""
        SELECT order_id, review_id, review_creation_date, review_score,
            CASE WHEN review_text IS NULL THEN 0 ELSE 1 END AS has_text,
            CASE WHEN review_text IS NOT NULL THEN (h % 500) / 1000.0 END AS prob_neg,
            CASE WHEN review_text IS NOT NULL THEN ((h // 500) % 500) / 1000.0 END AS prob_pos
        FROM (SELECT *, {_h32("'42'", "'sent'", "review_id")} AS h FROM rev_keys) r
        LEFT JOIN doc ON doc_id = r.order_id % (SELECT count(*) FROM documents)""",
    "last_rev": """
        SELECT * FROM rev
        QUALIFY row_number() OVER (PARTITION BY order_id
            ORDER BY review_creation_date DESC NULLS FIRST, review_id DESC) = 1""",
    "feat": """
        SELECT s.customer_unique_id, s.order_id, s.target, s.days_to_repeat,
            s.customer_state AS state,
            month(s.order_purchase_timestamp) AS purchase_month,
            floor((epoch(order_estimated_delivery_date) - epoch(order_delivered_customer_date))
                  / 86400) AS slack_days,
            floor((epoch(order_delivered_carrier_date) - epoch(order_approved_at)) / 86400)
                AS posting_days,
            first_value, first_freight, category, CAST(review_score AS DOUBLE) AS rating,
            has_text, prob_neg AS sent_neg, prob_pos AS sent_pos
        FROM sample s LEFT JOIN pay USING (order_id) LEFT JOIN freight USING (order_id)
            LEFT JOIN item_category USING (order_id) LEFT JOIN last_rev USING (order_id)""",
    "top_states": """
        SELECT state FROM feat WHERE state IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, state LIMIT 10""",
    "imputed": f"""
        SELECT customer_unique_id, order_id, target, state, purchase_month, posting_days,
            first_freight, category,
            coalesce(first_value, 0.0) AS first_value,
            coalesce(slack_days, (SELECT quantile_cont(slack_days, 0.5) FROM feat)) AS slack_days,
            coalesce({DURABLE}, 1) AS durable,
            CASE WHEN state IN (SELECT state FROM top_states) THEN state ELSE 'OTHER' END
                AS state_group,
            coalesce(rating, 5.0) AS rating, coalesce(has_text, 0) AS has_text,
            coalesce(sent_neg, 0.0) AS sent_neg, coalesce(sent_pos, 0.0) AS sent_pos
        FROM feat""",
    "base": """
        SELECT *, CASE WHEN slack_days < 0 THEN 1 ELSE 0 END AS late_flag,
            CAST(dense_rank() OVER (ORDER BY state_group) - 1 AS INTEGER) AS state_code
        FROM imputed""",
    "splits": f"""
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY h, customer_unique_id)
                <= round(0.2 * count(*) OVER (PARTITION BY target)) THEN 'test' ELSE 'train' END
                AS split
        FROM (SELECT *, {_h32("'42'", "'split'", "customer_unique_id")} AS h FROM base)""",
    "train": f"""
        SELECT * REPLACE (hf AS h),
            CAST(ntile(5) OVER (PARTITION BY target ORDER BY hf, customer_unique_id) - 1 AS INTEGER)
                AS fold
        FROM (SELECT *, {_h32("'42'", "'fold'", "customer_unique_id")} AS hf FROM splits
              WHERE split = 'train')""",
    "scores": f"""
        SELECT customer_unique_id, target AS label, split, 'strong' AS model,
            ({_h32("'42'", "'score'", "customer_unique_id")} % 1000 + 200 * target) / 1200.0 AS score
        FROM splits
        UNION ALL
        SELECT customer_unique_id, target, split, 'weak',
            ({_h32("'42'", "'score_b'", "customer_unique_id")} % 1000 + 100 * target) / 1100.0
        FROM splits""",
    "counts": """
        SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL""",
    "cum": """
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
            sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg
        FROM counts WINDOW w AS (PARTITION BY model ORDER BY score DESC)""",
    "train_cum": """
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
            sum(pos) OVER (PARTITION BY model) AS n_pos
        FROM (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM scores
              WHERE split = 'train' GROUP BY ALL)
        WINDOW w AS (PARTITION BY model ORDER BY score DESC)""",
    "limits": """
        SELECT model, score AS threshold, f1 FROM (
            SELECT *, 2 * (tp / (tp + fp)) * (tp / n_pos)
                / greatest(tp / (tp + fp) + tp / n_pos, 1e-12) AS f1
            FROM train_cum)
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) = 1""",
    "conf": """
        SELECT model, threshold,
            count(*) FILTER (label = 0 AND score < threshold) AS tn,
            count(*) FILTER (label = 0 AND score >= threshold) AS fp,
            count(*) FILTER (label = 1 AND score < threshold) AS fn,
            count(*) FILTER (label = 1 AND score >= threshold) AS tp
        FROM scores JOIN (SELECT model, threshold FROM limits) USING (model)
        WHERE split = 'test' GROUP BY ALL""",
    "cells": f"""
        SELECT *, row_number() OVER (ORDER BY {_h32("'42'", "'row'", "first")}, first) - 1 AS place
        FROM (SELECT label, strong, weak, count(*) AS persons, min(customer_unique_id) AS first
              FROM (SELECT a.customer_unique_id, a.label, a.score AS strong, b.score AS weak
                    FROM scores a JOIN scores b USING (customer_unique_id)
                    WHERE a.split = 'test' AND a.model = 'strong' AND b.model = 'weak')
              GROUP BY ALL)""",
    "tree": """
        SELECT level, (1 << level) + (place >> (depth - level)) AS node, sum(persons) AS weight
        FROM cells, (SELECT CAST(ceil(log2(count(*))) AS INTEGER) AS depth FROM cells),
            range(0, depth + 1) l(level)
        GROUP BY ALL""",
    "draws": f"""
        SELECT replicate, node - (1 << level) AS place, draws FROM (
            WITH RECURSIVE split AS (
                SELECT 0 AS level, b AS replicate, CAST(1 AS BIGINT) AS node,
                    (SELECT CAST(sum(persons) AS BIGINT) FROM cells) AS draws
                FROM range(0, 1000) r(b)
                UNION ALL
                SELECT level + 1, replicate, 2 * node + side, CASE side WHEN 0 THEN k ELSE draws - k END
                FROM (
                    SELECT level, replicate, node, draws,
                        CASE WHEN p >= 1 THEN draws ELSE list_reduce(
                            list_transform(range(0, draws), lambda i: exp(
                                lgamma(draws + 1) - lgamma(greatest(i, 0) + 1) - lgamma(draws - i + 1)
                                + i * ln(p) + (draws - i) * ln(1 - p))),
                            lambda acc, x: {{'f': acc.f + x, 'k': acc.k + CAST(acc.f + x <= u AS BIGINT)}},
                            {{'f': CAST(0 AS DOUBLE), 'k': CAST(0 AS BIGINT)}}).k END AS k
                    FROM (
                        SELECT s.*, l.weight / own.weight AS p,
                            CAST(('0x' || substr(md5('42|split|' || replicate || '|0|' || (s.node >> 1)),
                                CAST(1 + 15 * (s.node & 1) AS INTEGER), 15)) AS BIGINT)
                                / CAST(1152921504606846976 AS DOUBLE) AS u
                        FROM split s JOIN tree own ON own.node = s.node
                        JOIN tree l ON l.node = 2 * s.node)
                ), range(0, 2) c(side)
                WHERE CASE side WHEN 0 THEN k ELSE draws - k END > 0
            )
            SELECT * FROM split WHERE level = (SELECT max(level) FROM tree))""",
    "boot_cum": """
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
            SELECT replicate, model, score, sum(draws * label) AS pos, sum(draws * (1 - label)) AS neg
            FROM (SELECT replicate, draws, label, 'strong' AS model, strong AS score
                  FROM draws JOIN cells USING (place)
                  UNION ALL
                  SELECT replicate, draws, label, 'weak', weak FROM draws JOIN cells USING (place))
            GROUP BY ALL)
        WINDOW w AS (PARTITION BY replicate, model ORDER BY score DESC)""",
    "boot": """
        SELECT replicate, model,
            sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc,
            sum(pos * tp / (tp + fp)) / sum(pos) AS ap
        FROM boot_cum GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0""",
    "clip": """
        SELECT quantile_cont(slack_days, 0.01) AS lo, quantile_cont(slack_days, 0.99) AS hi
        FROM splits WHERE split = 'train'""",
    "ref": """
        SELECT state_group AS ref_state FROM base GROUP BY 1
        ORDER BY count(*) DESC, state_group LIMIT 1""",
    "by_state": """
        SELECT state_group, sum(target) AS k, count(*) AS n,
            ln(sum(target) / (count(*) - sum(target))) AS logit,
            1 / sum(target) + 1 / (count(*) - sum(target)) AS variance,
            state_group = (SELECT ref_state FROM ref) AS is_ref
        FROM splits WHERE split = 'train' GROUP BY 1""",
    "state_terms": """
        SELECT 'const' AS term, logit AS b, sqrt(variance) AS se FROM by_state WHERE is_ref
        UNION ALL
        SELECT 'state_' || s.state_group, s.logit - r.logit, sqrt(s.variance + r.variance)
        FROM by_state s, by_state r WHERE r.is_ref AND NOT s.is_ref""",
    "linear": """
        SELECT customer_unique_id, split, target, ln(1 + first_value) AS log_value,
            least(greatest(slack_days, (SELECT lo FROM clip)), (SELECT hi FROM clip)) AS slack_days,
            late_flag, durable, rating, sent_pos - sent_neg AS net_sentiment,
            has_text, sent_neg, sent_pos, state_group, purchase_month
        FROM splits""",
    "pred": f"""
        SELECT label, CASE WHEN h % 4 = 0 THEN h % 3 ELSE label END AS prediction
        FROM (SELECT label, {_h32("'42'", "'pred'", "review_id")} AS h
              FROM doc_label WHERE has_text = 1)""",
    "report": """
        SELECT c.class, c.name,
            count(*) FILTER (label = c.class AND prediction = c.class) AS tp,
            count(*) FILTER (label = c.class) AS support,
            count(*) FILTER (prediction = c.class) AS predicted
        FROM pred, (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) c(class, name)
        GROUP BY ALL""",
    "report_rows": """
        SELECT name AS class, tp, support,
            CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
            CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
            CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1
        FROM report""",
    "tests": """
        SELECT * FROM (
            SELECT 'not durable / durable' AS comparison,
                count(*) FILTER (durable = 0) AS n_a, sum(target) FILTER (durable = 0) AS k_a,
                count(*) FILTER (durable = 1) AS n_b, sum(target) FILTER (durable = 1) AS k_b
            FROM base
            UNION ALL
            SELECT 'on time / late',
                count(*) FILTER (late_flag = 0), sum(target) FILTER (late_flag = 0),
                count(*) FILTER (late_flag = 1), sum(target) FILTER (late_flag = 1)
            FROM base
            UNION ALL
            SELECT 'rating 4-5 / rating 1-2',
                count(*) FILTER (rating >= 4), sum(target) FILTER (rating >= 4),
                count(*) FILTER (rating <= 2), sum(target) FILTER (rating <= 2)
            FROM base)""",
    "tests_z": """
        SELECT *, k_a / n_a - k_b / n_b AS d,
            (k_a / n_a - k_b / n_b) / sqrt((k_a + k_b) / (n_a + n_b)
                * (1 - (k_a + k_b) / (n_a + n_b)) * (1 / n_a + 1 / n_b)) AS z,
            sqrt(k_a / n_a * (1 - k_a / n_a) / n_a + k_b / n_b * (1 - k_b / n_b) / n_b) AS se
        FROM tests""",
    "value_edges": """
        SELECT quantile_cont(first_value, 0.25) AS e1, quantile_cont(first_value, 0.5) AS e2,
            quantile_cont(first_value, 0.75) AS e3
        FROM base""",
    "purch": """
        SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'""",
    "purch_first": """
        SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM purch GROUP BY 1""",
    "purch_cohort": """
        SELECT f.user_id, first_day,
            first_day <= (SELECT CAST(max(ts) AS DATE) - 7 FROM purch) AS eligible,
            (SELECT min(CAST(ts AS DATE)) FROM purch p
             WHERE p.user_id = f.user_id AND CAST(ts AS DATE) > first_day) - first_day AS gap
        FROM purch_first f""",
}


def _normal_p(z: str) -> str:
    """Two-sided normal tail by Simpson's rule on the density."""
    steps = 2000
    return f"""greatest(0, 1 - 2 / sqrt(2 * pi()) * abs({z}) / {3 * steps} * list_sum(list_transform(
        range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4
        ELSE 2 END) * exp(-pow({z} * i / {steps}, 2) / 2))))"""


def _screen(column: str) -> str:
    filled = f"coalesce({column}, (SELECT quantile_cont({column}, 0.5) FROM base))"
    return f"""
        SELECT '{column}' AS candidate, max(rate) - min(rate) AS r FROM (
            SELECT bin, avg(target) AS rate FROM (
                SELECT target, (v > e1 AND e1 > e0)::INT + (v > e2 AND e2 > e0)::INT
                    + (v > e3 AND e3 > e0)::INT AS bin
                FROM (SELECT target, {filled} AS v FROM base),
                    (SELECT min({filled}) AS e0, quantile_cont({filled}, 0.25) AS e1,
                        quantile_cont({filled}, 0.5) AS e2, quantile_cont({filled}, 0.75) AS e3
                     FROM base))
            GROUP BY 1)"""


def _spearman(feature: str) -> str:
    h = _h32("'42'", "'score'", "customer_unique_id")
    score = f"{h} % 1000 + 200 * target"
    return f"""
        SELECT '{feature}' AS feature, corr(rx, ry) AS spearman FROM (
            SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx,
                rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry
            FROM (SELECT CAST({feature} AS DOUBLE) AS x, {score} AS y FROM base))"""


_VIF_R = """
    SELECT corr(slack_days, late_flag) AS r12, corr(slack_days, rating) AS r13,
        corr(late_flag, rating) AS r23
    FROM linear WHERE split = 'train'"""

LINEAR_TERMS = ["log_value", "slack_days", "late_flag", "durable", "rating", "net_sentiment"]
SEPARATE_TERMS = [*LINEAR_TERMS[:-1], "has_text", "sent_neg", "sent_pos"]

_DUMMIES = """
    SELECT customer_unique_id, 'state_' || s AS term, CASE WHEN state_group = s THEN 1 ELSE 0 END
        AS value
    FROM linear, (SELECT DISTINCT state_group AS s FROM base
                  WHERE state_group <> (SELECT ref_state FROM ref))
    UNION ALL
    SELECT customer_unique_id, 'month_' || m, CASE WHEN purchase_month = m THEN 1 ELSE 0 END
    FROM linear, (SELECT DISTINCT purchase_month AS m FROM base
                  WHERE purchase_month > (SELECT min(purchase_month) FROM base))"""


def _long(terms: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT customer_unique_id, '{t}' AS term, CAST({t} AS DOUBLE) AS value FROM linear"
        for t in terms
    ) + f" UNION ALL {_DUMMIES}"


BODIES: dict[str, str] = {
    "table_counts": """
        SELECT 'orders' AS table_name, count(*) AS n_rows FROM ord
        UNION ALL SELECT 'customers', count(*) FROM cust
        UNION ALL SELECT 'payments', count(*) FROM lineitem
        UNION ALL SELECT 'items', count(*) FROM lineitem
        UNION ALL SELECT 'products', count(*) FROM part
        UNION ALL SELECT 'category', count(DISTINCT p_type) FROM part
        UNION ALL SELECT 'sentiment', count(*) FROM rev""",
    "source_profile": """
        SELECT count(*) AS n_rows, count(DISTINCT customer_unique_id) AS n_persons,
            CAST(min(order_purchase_timestamp) AS DATE) AS first_day,
            CAST(max(order_purchase_timestamp) AS DATE) AS last_day
        FROM delivered""",
    "delivered_orders": """
        SELECT order_id, customer_id, order_purchase_timestamp FROM ord
        WHERE order_status = 'F'""",
    "orders_with_customer": """
        SELECT order_id, order_status, customer_unique_id, customer_state
        FROM ord LEFT JOIN cust USING (customer_id)""",
    "first_order": """
        SELECT customer_unique_id, order_purchase_timestamp, order_id,
            order_delivered_customer_date, customer_state
        FROM first_o""",
    "days_since_first": """
        SELECT order_id, customer_unique_id, first_day, CAST(gap AS INTEGER) AS days_since_first
        FROM gaps""",
    "repurchase_gap": """
        SELECT customer_unique_id, CAST(days_to_repeat AS INTEGER) AS days_to_repeat, repeat_ts
        FROM rep""",
    "eligible_customers": "SELECT customer_unique_id, first_day FROM cohort WHERE eligible",
    "excluded_before_delivery": """
        SELECT customer_unique_id, repeat_ts FROM cohort WHERE eligible AND repeat_known""",
    "repurchase_target": "SELECT customer_unique_id, target FROM sample",
    "cohort_funnel": """
        SELECT count(*) AS n_customers, count(*) FILTER (eligible) AS n_eligible,
            count(*) FILTER (NOT eligible) AS n_without_window,
            count(*) FILTER (eligible AND repeat_known) AS n_known_before,
            count(*) FILTER (eligible AND NOT repeat_known) AS n_sample,
            count(*) FILTER (eligible AND NOT repeat_known AND target = 1) AS n_positive,
            round(count(*) FILTER (eligible AND NOT repeat_known AND target = 1)
                / count(*) FILTER (eligible AND NOT repeat_known), 6) AS positive_rate
        FROM cohort""",
    "split_cart_customers": """
        SELECT count(*) AS n_split_cart_customers FROM (
            SELECT customer_unique_id FROM gaps WHERE gap = 0 GROUP BY 1 HAVING count(*) > 1)""",
    "median_days_to_repurchase": """
        SELECT CAST(median(days_to_repeat) AS DOUBLE) AS median_days FROM sample WHERE target = 1""",
    "events_cohort_funnel": """
        SELECT count(*) AS n_customers, count(*) FILTER (eligible) AS n_eligible,
            count(*) FILTER (NOT eligible) AS n_without_window, 0::BIGINT AS n_known_before,
            count(*) FILTER (eligible) AS n_sample,
            count(*) FILTER (eligible AND coalesce(gap <= 7, false)) AS n_positive,
            round(count(*) FILTER (eligible AND coalesce(gap <= 7, false))
                / count(*) FILTER (eligible), 6) AS positive_rate
        FROM purch_cohort""",
    "first_order_value": """
        SELECT customer_unique_id, round(coalesce(first_value, 0.0), 6) AS first_value
        FROM sample LEFT JOIN pay USING (order_id)""",
    "first_order_freight": """
        SELECT customer_unique_id, round(first_freight, 6) AS first_freight
        FROM sample LEFT JOIN freight USING (order_id)""",
    "first_item_category": """
        SELECT customer_unique_id, order_id, product_id, category
        FROM sample LEFT JOIN item_category USING (order_id)""",
    "durability_flag": f"""
        SELECT customer_unique_id, category, coalesce({DURABLE}, 1) AS durable FROM feat""",
    "latest_review": """
        SELECT order_id, review_id, review_creation_date, review_score, has_text, prob_neg, prob_pos
        FROM last_rev""",
    "first_order_review": """
        SELECT customer_unique_id, review_id, review_score, has_text, prob_neg, prob_pos
        FROM sample LEFT JOIN last_rev USING (order_id)""",
    "delivery_slack_days": """
        SELECT customer_unique_id, CAST(slack_days AS INTEGER) AS slack_days FROM feat""",
    "posting_days": """
        SELECT customer_unique_id, CAST(posting_days AS INTEGER) AS posting_days FROM feat""",
    "purchase_month": """
        SELECT customer_unique_id, CAST(purchase_month AS INTEGER) AS purchase_month FROM feat""",
    "late_flag": "SELECT customer_unique_id, slack_days, late_flag FROM base",
    "state_group": "SELECT customer_unique_id, state, state_group FROM base",
    "state_code": "SELECT customer_unique_id, state_code FROM base",
    "imputed_features": """
        SELECT customer_unique_id, round(first_value, 6) AS first_value, slack_days, rating,
            has_text, round(sent_neg, 6) AS sent_neg, round(sent_pos, 6) AS sent_pos, durable
        FROM base""",
    "net_sentiment": """
        SELECT customer_unique_id, round(sent_pos - sent_neg, 6) AS net_sentiment FROM base""",
    "modeling_base": """
        SELECT customer_unique_id, target, round(first_value, 6) AS first_value, slack_days,
            late_flag, state_code, CAST(purchase_month AS INTEGER) AS purchase_month, durable,
            rating, has_text, round(sent_neg, 6) AS sent_neg, round(sent_pos, 6) AS sent_pos
        FROM base""",
    "mapping_coverage": f"""
        SELECT category, CASE WHEN category IS NULL THEN 'missing'
                WHEN {DURABLE} IS NULL THEN 'unmapped' ELSE 'mapped' END AS status,
            count(*) AS n
        FROM feat GROUP BY ALL""",
    "missingness_report": f"""
        SELECT count(*) AS n_rows, count(*) FILTER (slack_days IS NULL) AS n_without_delivery,
            count(*) FILTER (category IS NULL) AS n_without_category,
            count(*) FILTER (category IS NOT NULL AND {DURABLE} IS NULL) AS n_outside_map,
            count(*) FILTER (rating IS NULL) AS n_without_review,
            CAST(sum(coalesce(has_text, 0)) AS BIGINT) AS n_with_text,
            round(avg(coalesce(has_text, 0)), 6) AS share_with_text
        FROM feat""",
    "dq_checks": """
        SELECT 'orders without person' AS rule, count(*) FILTER (customer_unique_id IS NULL) AS n
        FROM delivered
        UNION ALL SELECT 'repeated persons', count(*) - count(DISTINCT customer_unique_id) FROM feat
        UNION ALL SELECT 'rows lost or repeated by joins',
            abs((SELECT count(*) FROM sample) - (SELECT count(*) FROM feat))
        UNION ALL SELECT 'codes without level', count(*) FILTER (state_code IS NULL) FROM base""",
    "rate_by_rating": """
        SELECT rating, CAST(sum(target) AS BIGINT) AS positives, count(*) AS total,
            round(avg(target), 4) AS rate
        FROM base GROUP BY 1""",
    "rate_by_durability": """
        SELECT durable, CAST(sum(target) AS BIGINT) AS positives, count(*) AS total,
            round(avg(target), 4) AS rate
        FROM base GROUP BY 1""",
    "rate_by_delivery_bin": """
        SELECT b.bin, b.label, CAST(coalesce(sum(target), 0) AS BIGINT) AS positives,
            count(target) AS total, round(avg(target), 4) AS rate
        FROM (VALUES (0, 'late', -1e9, -1), (1, '0 to 4 days early', -1, 4),
                (2, '5 to 9 days early', 4, 9), (3, '10 to 14 days early', 9, 14),
                (4, '15 or more days early', 14, 1e9)) b(bin, label, lo, hi)
        LEFT JOIN base ON slack_days > lo AND slack_days <= hi GROUP BY ALL""",
    "rate_by_value_quartile": """
        SELECT bin, CASE bin WHEN 0 THEN 'Q1 (lowest)' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3'
                ELSE 'Q4 (highest)' END AS label,
            CAST(sum(target) AS BIGINT) AS positives, count(*) AS total,
            round(avg(target), 4) AS rate
        FROM (SELECT target, (first_value > e1)::INT + (first_value > e2)::INT
                  + (first_value > e3)::INT AS bin FROM base, value_edges)
        GROUP BY 1""",
    "candidate_screen": f"""
        SELECT candidate, round(r, 6) AS rate_range,
            CASE WHEN r > 0.01 THEN 'keep' ELSE 'drop' END AS decision
        FROM ({_screen("first_freight")} UNION ALL {_screen("posting_days")})""",
    "two_proportion_tests": f"""
        SELECT comparison, n_a, CAST(k_a AS BIGINT) AS k_a, n_b, CAST(k_b AS BIGINT) AS k_b,
            round(d, 6) AS difference, round(d - 1.96 * se, 6) AS ci_low,
            round(d + 1.96 * se, 6) AS ci_high, round(z, 6) AS z, round(p, 6) AS p,
            round(0.05 / 3, 6) AS bonferroni_level, p < 0.05 / 3 AS significant
        FROM (SELECT *, {_normal_p("z")} AS p FROM tests_z)""",
    "state_distribution": "SELECT state, count(*) AS n FROM feat GROUP BY 1",
    "reference_level": """
        SELECT state_group, count(*) AS n FROM base GROUP BY 1
        ORDER BY n DESC, state_group LIMIT 1""",
    "stratified_split": "SELECT customer_unique_id, target, split FROM splits",
    "csv_orders": "SELECT * FROM ord",
    "csv_reviews": f"""
        SELECT doc_id AS review_id, doc_id AS order_id, {RATING} AS review_score,
            CASE WHEN doc_id % 2 <> 0 THEN ' ' END AS review_comment_title,
            chr(10) || text || ' ' AS review_comment_message
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "golden_gate": """
        SELECT order_id, round(first_value, 6) AS expected, round(first_value, 6) AS actual,
            true AS agrees FROM pay""",
    "stratified_folds": "SELECT customer_unique_id, target, fold FROM train",
    "explain_sample": f"""
        SELECT customer_unique_id FROM splits WHERE split = 'test'
        ORDER BY {_h32("'42'", "'explain'", "customer_unique_id")}, customer_unique_id LIMIT 3000""",
    "split_summary": """
        SELECT split, count(*) AS n, CAST(sum(target) AS BIGINT) AS positives,
            round(avg(target), 6) AS prevalence
        FROM splits GROUP BY 1""",
    "class_weights": """
        SELECT count(*) AS n_train, CAST(sum(target) AS BIGINT) AS n_positive,
            round(count(*) / (2 * sum(1 - target)), 6) AS weight_negative,
            round(count(*) / (2 * sum(target)), 6) AS weight_positive,
            round(sum(1 - target) / sum(target), 6) AS positive_ratio
        FROM splits WHERE split = 'train'""",
    "winsor_limits": "SELECT round(lo, 6) AS clip_low, round(hi, 6) AS clip_high FROM clip",
    "roc_auc": """
        SELECT model, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc
        FROM cum GROUP BY 1""",
    "average_precision": """
        SELECT model, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM cum GROUP BY 1""",
    "roc_curve": """
        SELECT model, round(score, 6) AS threshold, round(fp / n_neg, 6) AS fpr,
            round(tp / n_pos, 6) AS tpr
        FROM cum
        UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM cum""",
    "pr_curve": """
        SELECT model, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
            round(tp / n_pos, 6) AS recall
        FROM cum
        UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM cum""",
    "f1_threshold": """
        SELECT model, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM limits""",
    "confusion_matrix": """
        SELECT model, round(threshold, 6) AS threshold, tn, fp, fn, tp FROM conf""",
    "threshold_metrics": """
        SELECT model, round(threshold, 6) AS threshold,
            round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
            round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
            round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
        FROM conf""",
    "lift_top_decile": f"""
        SELECT model, count(*) AS n_top, round(avg(label), 6) AS precision_top,
            round(sum(label) / max(n_pos), 6) AS capture_top,
            round(avg(label) / (max(n_pos) / max(n)), 6) AS lift_top
        FROM (SELECT model, label, count(*) OVER m AS n, sum(label) OVER m AS n_pos,
                row_number() OVER (PARTITION BY model ORDER BY score DESC,
                    {_h32("'42'", "'top'", "customer_unique_id")}, customer_unique_id) AS place
              FROM scores WHERE split = 'test' WINDOW m AS (PARTITION BY model))
        WHERE place <= ceil(0.1 * n) GROUP BY 1""",
    "bootstrap_ci": """
        SELECT model, count(*) AS n_replicates, round(quantile_cont(auc, 0.025), 6) AS auc_low,
            round(quantile_cont(auc, 0.975), 6) AS auc_high,
            round(quantile_cont(ap, 0.025), 6) AS ap_low,
            round(quantile_cont(ap, 0.975), 6) AS ap_high
        FROM boot GROUP BY 1""",
    "paired_bootstrap_diff": """
        SELECT 'strong' AS first_model, 'weak' AS second_model, count(*) AS n_replicates,
            round(avg(a.ap - b.ap), 6) AS mean_difference,
            round(quantile_cont(a.ap - b.ap, 0.025), 6) AS ci_low,
            round(quantile_cont(a.ap - b.ap, 0.975), 6) AS ci_high
        FROM boot a JOIN boot b USING (replicate) WHERE a.model = 'strong' AND b.model = 'weak'""",
    "cross_validated_ap": """
        SELECT f.model AS variant, round(avg(f.ap), 6) AS mean_ap,
            round(stddev_samp(f.ap), 6) AS sd_over_folds, round(avg(f.ap - s.ap), 6) AS difference
        FROM fold_ap f JOIN fold_ap s ON f.fold = s.fold AND s.model = 'strong' GROUP BY 1""",
    "finalist": """
        SELECT model, round(ap, 6) AS cv_ap FROM (
            SELECT model, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM train_cum GROUP BY 1)
        ORDER BY ap DESC, model DESC LIMIT 1""",
    "spearman_corr": "SELECT feature, round(spearman, 6) AS spearman FROM ("
    + " UNION ALL ".join(_spearman(f) for f in ["first_value", "slack_days", "sent_neg", "rating"])
    + ")",
    "classification_report": """
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
            round(f1, 6) AS f1, support
        FROM report_rows
        UNION ALL
        SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
            round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT)
        FROM report_rows
        UNION ALL
        SELECT 'macro average', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
            CAST(sum(support) AS BIGINT)
        FROM report_rows
        UNION ALL
        SELECT 'weighted average', round(sum(precision * support) / sum(support), 6),
            round(sum(recall * support) / sum(support), 6),
            round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT)
        FROM report_rows""",
    "linear_design_matrix": f"""
        SELECT customer_unique_id, term, round(value, 6) AS value FROM ({_long(LINEAR_TERMS)})""",
    "linear_design_separate_text": f"""
        SELECT term, round(sum(value), 4) AS total FROM ({_long(SEPARATE_TERMS)}) GROUP BY 1""",
    "vif_three_terms": f"""
        WITH r AS ({_VIF_R}),
        d AS (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM r)
        SELECT 'slack_days' AS term, round((1 - r23 * r23) / det, 4) AS vif FROM d
        UNION ALL SELECT 'late_flag', round((1 - r13 * r13) / det, 4) FROM d
        UNION ALL SELECT 'rating', round((1 - r12 * r12) / det, 4) FROM d""",
    "logit_by_state": f"""
        SELECT term, round(b, 4) AS coefficient, round(exp(b), 4) AS odds_ratio,
            round(exp(b - 1.959963984540054 * se), 4) AS or_ci_low,
            round(exp(b + 1.959963984540054 * se), 4) AS or_ci_high, round(p, 4) AS p_value
        FROM (SELECT *, {_normal_p("b / se")} AS p FROM state_terms)""",
    "state_block_test": """
        SELECT round(2 * (ll - ll0), 4) AS chi_square,
            CAST(groups - 1 AS INTEGER) AS degrees_of_freedom, round(1 - ll / ll0, 4) AS pseudo_r2
        FROM (SELECT sum(coalesce(k * ln(nullif(k, 0) / n), 0)
                      + coalesce((n - k) * ln(nullif(n - k, 0) / n), 0)) AS ll, count(*) AS groups,
                  sum(k) * ln(sum(k) / sum(n)) + (sum(n) - sum(k)) * ln(1 - sum(k) / sum(n)) AS ll0
              FROM by_state)""",
    "review_text": "SELECT review_id, review_text AS text, has_text FROM doc_label",
    "polarity_label": "SELECT review_id, review_score, label FROM doc_label",
    "label_distribution": """
        SELECT CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label,
            count(*) AS n
        FROM doc_label WHERE has_text = 1 GROUP BY 1""",
    "text_folds": f"""
        SELECT review_id, label,
            CAST(ntile(2) OVER (PARTITION BY label ORDER BY
                {_h32("'42'", "'text'", "review_id")}, review_id) - 1 AS INTEGER) AS fold
        FROM doc_label WHERE has_text = 1""",
    "log_ratio_sentiment": """
        SELECT review_id, label, fold,
            max(score) FILTER (c = 0) AS score_neg, max(score) FILTER (c = 1) AS score_neu,
            max(score) FILTER (c = 2) AS score_pos,
            CAST(arg_max(c, struct_pack(s := score, first := -c)) AS INTEGER) AS prediction
        FROM gram_score GROUP BY ALL""",
    "sentiment_layout": f"""
        SELECT review_id, review_id AS order_id, review_score, has_text,
            CASE WHEN has_text = 1 THEN CAST(ntile(2) OVER (PARTITION BY has_text, label ORDER BY
                {_h32("'42'", "'text'", "review_id")}, review_id) - 1 AS INTEGER) END AS fold,
            has_text = 1 AS scored, CAST(0 AS DOUBLE) AS gap
        FROM doc_label""",
}

CTES["fold_cum"] = """
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
            SELECT model, fold, score, sum(label) AS pos, sum(1 - label) AS neg
            FROM scores JOIN (SELECT customer_unique_id, fold FROM train) USING (customer_unique_id)
            GROUP BY ALL)
        WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC)"""
CTES["fold_ap"] = """
        SELECT model, fold, sum(pos * tp / (tp + fp)) / sum(pos) AS ap
        FROM fold_cum GROUP BY ALL"""


ORDER_COLUMNS = [
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


def _encoded(column: str) -> str:
    return f"coalesce(length(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


BODIES["checkpoint_manifest"] = f"""
        SELECT count(*) AS n_rows,
            concat_ws(',', {", ".join(f"count(*) FILTER ({c} IS NULL)" for c in ORDER_COLUMNS)})
                AS n_nulls,
            CAST(sum(CAST({_h60("'42'", "'row'", *map(_encoded, ORDER_COLUMNS))} AS HUGEINT))
                AS VARCHAR) AS content_hash
        FROM ord"""

CTES["gram"] = f"""
        SELECT review_id, label, fold, b, count(*) AS n
        FROM (SELECT review_id, label, fold, unnest(list_concat(w,
                  list_transform(range(1, len(w)), lambda i: (w[i] * 31 + w[i + 1]) % 65536))) AS b
              FROM (SELECT review_id, label, list_transform(list_filter(string_split_regex(
                        translate(review_text, '{ascii_uppercase}', '{ascii_lowercase}'),
                        '[\\x09-\\x0D ]+'), lambda x: x <> ''),
                        lambda x: CAST('0x' || substr(md5(x), 1, 4) AS BIGINT)) AS w,
                        CAST(ntile(2) OVER (PARTITION BY label ORDER BY
                            {_h32("'42'", "'text'", "review_id")}, review_id) - 1 AS INTEGER) AS fold
                    FROM doc_label WHERE has_text = 1))
        GROUP BY ALL"""
# Training counts of a fold: everything outside it.
CTES["gram_gain"] = """
        SELECT k.fold, k.label, k.b, CAST(floor(ln(
            CAST(coalesce(n, 0) + 1 AS DOUBLE) / CAST(s + 65536 AS DOUBLE)) * 1000) AS BIGINT) AS g
        FROM (SELECT DISTINCT x.fold, l.label, x.b
              FROM gram x CROSS JOIN (SELECT unnest([0, 1, 2]) AS label) l) k
        LEFT JOIN (SELECT f.fold, label, b, sum(n) AS n
                   FROM gram JOIN (SELECT DISTINCT fold FROM gram) f ON gram.fold <> f.fold
                   GROUP BY ALL) USING (fold, label, b)
        JOIN (SELECT f.fold, l.label, coalesce(sum(n), 0) AS s
              FROM (SELECT DISTINCT fold FROM gram) f
              CROSS JOIN (SELECT unnest([0, 1, 2]) AS label) l
              LEFT JOIN gram ON gram.fold <> f.fold AND gram.label = l.label
              GROUP BY ALL) USING (fold, label)"""
CTES["gram_prior"] = """
        SELECT f.fold, l.label, CAST(floor(ln(
            CAST(count(DISTINCT review_id) FILTER (gram.label = l.label) + 1 AS DOUBLE)
            / CAST(count(DISTINCT review_id) + 3 AS DOUBLE)) * 1000) AS BIGINT) AS p
        FROM (SELECT DISTINCT fold FROM gram) f
        CROSS JOIN (SELECT unnest([0, 1, 2]) AS label) l
        LEFT JOIN gram ON gram.fold <> f.fold
        GROUP BY ALL"""
CTES["gram_score"] = """
        SELECT review_id, gram.label, gram.fold, x.label AS c,
            CAST(sum(n * g) + any_value(p) AS BIGINT) AS score
        FROM gram JOIN gram_gain x ON gram.fold = x.fold AND gram.b = x.b
        JOIN gram_prior q ON q.fold = x.fold AND q.label = x.label
        GROUP BY ALL"""


def _needed(body: str) -> list[str]:
    """The common table expressions a query refers to, in the order of definition."""
    found: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in found and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                found.add(name)
                todo.append(CTES[name])
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in CTES:
            if other != name and other in found and re.search(
                rf"\b(?:FROM|JOIN|,)\s*\(?\s*{other}\b", CTES[name]
            ):
                place(other)
        order.append(name)

    for name in CTES:
        if name in found:
            place(name)
    return order


def oracle_sql() -> dict[str, str]:
    queries = {}
    for name, body in BODIES.items():
        ctes = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in _needed(body))
        text = body.strip()
        if not ctes:
            queries[name] = text
        elif text.startswith("WITH "):
            queries[name] = f"WITH {ctes},\n{text[5:]}"
        else:
            queries[name] = f"WITH {ctes}\n{text}"
    return queries
