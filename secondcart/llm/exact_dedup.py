"""Exact deduplication that no hot text can stall: local, salted and global combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns
from secondcart.llm.rows import ROW, identified, without

SALTS = 32
# Runs to be replaced by one blank; a single blank already is one and needs no work.
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """Text with every run of white space replaced by one blank; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), RUNS, " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per different text of ``rows`` (digest, text, id, salt): its smallest id and
    number of rows.

    The text itself is part of every grouping key, so equal digests never merge different texts.
    Partial aggregation first merges equal rows inside each task; what is left of a text is
    spread over ``salts`` groups, and only the winners of these meet in one place: at most
    ``salts`` rows per text however many copies there are.
    """
    local = rows.groupBy("digest", "salt", "text").agg(
        F.min("id").alias("id"), F.count("*").alias("n")
    )
    return local.groupBy("digest", "text").agg(
        F.min("id").alias("keep_id"), F.sum("n").alias("group_size")
    )


def exact_groups(
    docs: DataFrame, salts: int = SALTS, digest=sha256_of, id_column: str = "doc_id"
) -> DataFrame:
    """The group of every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white-space runs became one blank. The row with
    the smallest ``doc_id`` of equal texts stays. Rows without ``doc_id`` join their group but
    stay only if no row of it has an id; of rows that share the smallest id all stay, since
    nothing tells them apart (:func:`drop_copies` numbers rows and keeps one). A NULL text equals
    an empty one. ``digest`` only speeds the comparison up: where two different texts share a
    digest, rows are matched by their texts. Very long texts are compared whole. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    text = normalised(F.col("text"))
    rows = exact_columns(docs, id_column, "text").select(
        F.col(id_column).cast("long").alias("id"),
        text.alias("text"),
        digest(text).alias("digest"),
        F.pmod(F.xxhash64(id_column), F.lit(salts)).alias("salt"),
    )
    return _members(rows, winners(rows, salts), digest is sha256_of)


def _members(rows: DataFrame, won: DataFrame, wide: bool) -> DataFrame:
    right = won.select("digest", "text", "keep_id", "group_size")
    if wide:
        # No two different texts share a SHA-256 unless someone has broken it; then the row of
        # the other text is found below by its second digest, not merged.
        key = F.md5(F.col("text").cast("binary"))
        left = rows.select("id", "digest", key.alias("check"))
        right = right.select("digest", key.alias("check"), "keep_id", "group_size")
    else:
        left = rows.select("id", "digest", F.col("text").alias("check"))
        right = right.withColumnRenamed("text", "check")
    right = right.withColumnsRenamed({"digest": "r_digest", "check": "r_check"})
    same = (F.col("digest") == F.col("r_digest")) & (F.col("check") == F.col("r_check"))
    return left.join(right, same, "left").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: the one with the smallest ``doc_id``, or the first
    where ids are missing or repeated."""
    rows = identified(docs)
    groups = exact_groups(rows, id_column=ROW)
    return without(rows, groups.where(~F.col("kept")).select("doc_id"))
