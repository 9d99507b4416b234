"""Joins that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.sources.writers import materialize

HOT_SHARE = 1024
SALTS = 64


def lookup_by_hot_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    hot_share: int = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Left join to ``right``, which has one row per key and in ``weight`` the number of left
    rows with that key.

    Keys with more than one in ``hot_share`` of all rows are at most ``hot_share`` keys, so their
    list can be broadcast whatever the size of the data. Rows of those keys get one of ``salts``
    values and the few matching right rows are repeated per salt, which spreads a hot key over
    that many tasks. Adaptive execution alone does not do this here: it splits a side only where
    both come straight from a shuffle, and ``right`` comes from an aggregation.

    ``right`` is needed for the total, for the hot keys and for the join, so it is written once.
    """
    right = materialize(right, "per-key")
    total = right.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * hot_share > total
    hot = right.where(is_hot).select(key, F.lit(salts).alias("_salts"))
    every_salt = F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0))
    salted_right = right.withColumn("_salt", F.explode(every_salt))
    # The salt is a hash of the row, not a random number: a recomputed task must send every row
    # to the same place again.
    row_salt = F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int")
    salted_left = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), row_salt).otherwise(0)
    )
    return salted_left.join(salted_right, [key, "_salt"], "left").drop("_salt", "_salts")
