"""Removing decided rows from a table without moving its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.sources.writers import materialize

# Numbers of removed rows (8 bytes each) up to this many are broadcast; more are joined.
BROADCAST_ROWS = 1_000_000
ROW = "_row"


def identified(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with a first column ``_row``, a number that no other row has.

    That is ``key`` where every row has one of its own. Otherwise rows are numbered, and
    written so that the numbers stay. Columns of the same name become ``_row_1`` and so on for
    the time being; :func:`without` gives them back.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    if key in names:
        own = plain[f"_{names.index(key)}"].cast("long")
        seen = plain.agg(F.count("*").alias("rows"), F.count_distinct(own).alias("ids")).first()
        if seen["rows"] == seen["ids"]:
            return plain.select(own.alias(ROW), *plain.columns).toDF(ROW, *names)
    numbered = plain.select(F.monotonically_increasing_id().alias(ROW), *plain.columns)
    return materialize(numbered, "numbered").toDF(ROW, *names)


def without(numbered: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of an :func:`identified` table whose number is not in ``dropped``'s only column."""
    names = numbered.columns[1:]
    plain = numbered.toDF(ROW, *[f"_{i}" for i in range(len(names))])
    dropped = materialize(dropped.toDF(ROW), "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return plain.join(dropped, ROW, "left_anti").drop(ROW).toDF(*names)
