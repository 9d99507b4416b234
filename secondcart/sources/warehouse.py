"""The logical tables of a study, derived from the star-schema tables of a warehouse folder.

A warehouse folder holds ``orders``, ``lineitem``, ``customer``, ``nation``, ``part``,
``documents``, ``labels`` and ``events`` as Parquet. Some columns a study needs do not exist
there (delivery dates, reviews of an order), so they are computed from the keys with integer
arithmetic. Everything here is a projection or an equi-join over all rows and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secondcart.functions.hashing import hash32
from secondcart.functions.text import consolidated_text, has_text

SPLIT_CART_OFFSET = 100_000_000

# Orders with this status count as delivered. It stays as it is stored, so that the filter on it
# reaches the file scan.
DELIVERED_STATUS = "F"

# Durability of the part types that stand for product categories here.
PART_TYPE_DURABILITY = {"economy": 0, "small": 0, "promo": 0, "medium": 1, "standard": 1}


def read_warehouse(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def folder_state(spark: SparkSession, folder: str) -> str:
    """Changes when a table of the folder is written again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    tables = path.getFileSystem(conf).listStatus(path)
    return "|".join(
        sorted(f"{t.getPath().getName()}:{t.getLen()}:{t.getModificationTime()}" for t in tables)
    )


def _hours(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), count.cast("int"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders; every 25th key also appears as a second order of the same day (a split cart)."""
    k = F.col("order_id")
    day = F.col("o_orderdate")
    placed = k % 24
    keys = F.when(
        F.col("o_orderkey") % 25 == 0,
        F.array("o_orderkey", F.col("o_orderkey") + F.lit(SPLIT_CART_OFFSET)),
    ).otherwise(F.array("o_orderkey"))
    return (
        read_warehouse(spark, folder, "orders")
        .select(F.explode(keys).alias("order_id"), "o_custkey", "o_orderstatus", "o_orderdate")
        .select(
            "order_id",
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            (day + _hours(placed)).alias("order_purchase_timestamp"),
            (day + _hours(placed + k % 3)).alias("order_approved_at"),
            (day + _hours(placed + 24 + (k * 7) % 96)).alias("order_delivered_carrier_date"),
            F.when(k % 97 != 0, day + _hours(placed + 24 * (3 + (k * 13) % 35))).alias(
                "order_delivered_customer_date"
            ),
            (day + _hours(F.lit(720))).alias("order_estimated_delivery_date"),
        )
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_warehouse(spark, folder, "customer")
    nation = read_warehouse(spark, folder, "nation")
    return customer.join(
        nation, customer["c_nationkey"] == nation["n_nationkey"], "left"
    ).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("n_name").alias("customer_state"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    return read_warehouse(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias(
            "payment_value"
        ),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines. ``tie_supplier`` and ``tie_price`` only make the item order total, because
    line numbers repeat inside an order in these tables."""
    return read_warehouse(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        F.col("l_suppkey").alias("tie_supplier"),
        F.col("l_extendedprice").alias("tie_price"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return read_warehouse(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
    )


def category(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read_warehouse(spark, folder, "part")
        .select(F.col("p_type").alias("product_category_name"))
        .distinct()
        .withColumn("product_category_name_english", F.lower("product_category_name"))
    )


def _rating() -> Column:
    quality, toxic = F.col("quality"), F.col("toxic")
    return (
        F.when((quality == 0) & (toxic == 1), 2)
        .when(quality == 0, 1)
        .when((quality == 1) & (toxic == 1), 3)
        .when(quality == 1, 5)
        .otherwise(4)
        .cast("int")
    )


def _title() -> Column:
    return F.when(F.col("doc_id") % 2 != 0, F.lit(" "))


def _message() -> Column:
    return F.concat(F.lit("\n"), F.col("text"), F.lit(" "))


def document_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """One review per document: rating from its labels, text from title and message."""
    documents = read_warehouse(spark, folder, "documents").select("doc_id", "text")
    labels = read_warehouse(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("doc_id").alias("order_id"),
        _rating().alias("review_score"),
        F.lit(None).cast("timestamp_ntz").alias("review_creation_date"),
        _title().alias("review_comment_title"),
        _message().alias("review_comment_message"),
    )


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The consolidated text of every document's review, without a join."""
    return read_warehouse(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"), consolidated_text(_title(), _message()).alias("text")
    )


def document_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Rating of every document and whether it has a text. The text becomes a flag in the scan,
    before the join, so no text is shuffled."""
    documents = read_warehouse(spark, folder, "documents").select(
        "doc_id", has_text(consolidated_text(_title(), _message())).alias("has_text")
    )
    labels = read_warehouse(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", _rating().alias("review_score"), "has_text"
    )


def sentiment(spark: SparkSession, folder: str, seed: int = 42) -> DataFrame:
    """Reviews of orders with their class probabilities; every 20th order has two."""
    documents = document_ratings(spark, folder)
    n_documents = read_warehouse(spark, folder, "documents").agg(F.count("*")).scalar()
    k = F.col("o_orderkey")
    copies = F.when(k % 20 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    reviews = (
        read_warehouse(spark, folder, "orders")
        .select(
            "o_orderkey",
            "o_orderdate",
            (k % n_documents).alias("doc_id"),
            F.explode(copies).alias("copy"),
        )
        .select(
            "doc_id",
            F.col("o_orderkey").alias("order_id"),
            (k * 2 + F.col("copy")).alias("review_id"),
            (F.col("o_orderdate") + _hours(240 + 24 * F.col("copy"))).alias("review_creation_date"),
        )
    )
    h = hash32(seed, "sent", "review_id")
    with_text = F.col("has_text") == 1
    return reviews.join(documents, "doc_id", "left").select(
        "review_id",
        "order_id",
        "review_score",
        "review_creation_date",
        "has_text",
        F.when(with_text, (h % 500) / F.lit(1000.0)).alias("prob_neg"),
        F.when(with_text, (F.floor(h / 500) % 500) / F.lit(1000.0)).alias("prob_pos"),
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events, as a second history of orders without delivery or customer tables."""
    return (
        read_warehouse(spark, folder, "events")
        .where(F.col("event_type") == "purchase")
        .select("user_id", "event_id", "ts")
    )


def logical_tables(spark: SparkSession, folder: str, seed: int = 42) -> dict[str, DataFrame]:
    return {
        "orders": orders(spark, folder),
        "customers": customers(spark, folder),
        "payments": payments(spark, folder),
        "items": items(spark, folder),
        "products": products(spark, folder),
        "category": category(spark, folder),
        "sentiment": sentiment(spark, folder, seed),
    }
