"""Declared schemas of the logical input tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "orders": (
        "order_id STRING, customer_id STRING, order_status STRING,"
        " order_purchase_timestamp TIMESTAMP_NTZ, order_approved_at TIMESTAMP_NTZ,"
        " order_delivered_carrier_date TIMESTAMP_NTZ, order_delivered_customer_date TIMESTAMP_NTZ,"
        " order_estimated_delivery_date TIMESTAMP_NTZ"
    ),
    "customers": (
        "customer_id STRING, customer_unique_id STRING, customer_zip_code_prefix STRING,"
        " customer_city STRING, customer_state STRING"
    ),
    "payments": (
        "order_id STRING, payment_sequential INT, payment_type STRING,"
        " payment_installments INT, payment_value DOUBLE"
    ),
    "items": (
        "order_id STRING, order_item_id INT, product_id STRING, seller_id STRING,"
        " shipping_limit_date TIMESTAMP_NTZ, price DOUBLE, freight_value DOUBLE"
    ),
    "products": (
        "product_id STRING, product_category_name STRING, product_name_lenght INT,"
        " product_description_lenght INT, product_photos_qty INT, product_weight_g INT,"
        " product_length_cm INT, product_height_cm INT, product_width_cm INT"
    ),
    "category": (
        "product_category_name STRING, product_category_name_english STRING"
    ),
    "reviews": (
        "review_id STRING, order_id STRING, review_score INT, review_comment_title STRING,"
        " review_comment_message STRING, review_creation_date TIMESTAMP_NTZ,"
        " review_answer_timestamp TIMESTAMP_NTZ"
    ),
    "sentiment": (
        "review_id STRING, order_id STRING, review_score INT, review_creation_date TIMESTAMP_NTZ,"
        " has_text INT, prob_neg DOUBLE, prob_neu DOUBLE, prob_pos DOUBLE,"
        " sentiment_label STRING, fold INT"
    ),
    "base": (
        "customer_unique_id STRING, target INT, first_value DOUBLE, slack_days DOUBLE,"
        " late_flag INT, state_code INT, purchase_month INT, durable INT, rating DOUBLE,"
        " has_text INT, sent_neg DOUBLE, sent_pos DOUBLE"
    ),
}


def table_schema(name: str) -> StructType:
    """Schema of a logical table (needs a running session to parse the definition)."""
    return StructType.fromDDL(SCHEMAS[name])
