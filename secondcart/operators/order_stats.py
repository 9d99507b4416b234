"""Ranks, running totals, exact quantiles and selections by rank, without sorting everything in
one task.

A bare ``Window.orderBy`` sends all rows to one task. Here the order column is cut into buckets
first: totals per bucket are small and give each bucket its starting offset, and inside a bucket
an ordinary window finishes the job. Any set of bucket bounds gives the same result; good bounds
only make the buckets even. Rows whose order column is NULL have no place in the order: they are
left out. NULL is a group like any other. Quantiles need no order at all: they come from counts of
leading bits.
"""

from __future__ import annotations

import bisect
import math
import struct
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondcart.functions.hashing import HASH32_BITS
from secondcart.sources.writers import materialize

ROWS_PER_WINDOW = 1_000_000
HASH_BUCKET_BITS = 10
# Counts that one pass of a selection brings together.
COUNTS_PER_PASS = 1 << 16
MAX_STRATA = 256


def hash_bucket_bits(rows: int, rows_per_window: int = ROWS_PER_WINDOW) -> int:
    """Leading hash bits that number the buckets: at least 1024 buckets, and so many that one
    holds about ``rows_per_window`` rows."""
    return min(HASH32_BITS - 8, max(HASH_BUCKET_BITS, (rows // rows_per_window).bit_length()))


def hash_bucket(h: Column, bits: int = HASH_BUCKET_BITS) -> Column:
    """Leading bits of a 32-bit hash: buckets that are even by construction."""
    return F.shiftright(h, HASH32_BITS - bits).cast("int")


def bucket_edges(
    values: DataFrame, column: str, rows_per_window: int = ROWS_PER_WINDOW, rows: int | None = None
) -> list[float]:
    """Inner bucket bounds so that a bucket holds about ``rows_per_window`` rows.

    The number of rows (counted unless given) decides how many there are; with none, one bucket
    holds all. The driver gets one number per ``rows_per_window`` rows; they come here so that
    every use in a plan sees the same bounds.
    """
    rows = values.count() if rows is None else rows
    wanted = max(1, math.ceil(rows / rows_per_window))
    shares = [i / wanted for i in range(1, wanted)]
    numeric = values.select(F.col(column).cast("double").alias("value"))
    if not shares:
        return []
    return sorted(set(numeric.approxQuantile("value", shares, 1 / (4 * wanted))))


def with_bucket(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """``_bucket``: number of the bucket of a numeric column."""
    if not edges:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [-math.inf, *edges, math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket")
    numeric = df.withColumn("_value", F.col(column).cast("double"))
    return bucketizer.transform(numeric).drop("_value")


def running_totals_in_buckets(
    df: DataFrame,
    groups: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    measures: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Running sums per group when ``bucket`` already follows the order of ``order``."""
    step = F.desc(bucket) if descending else F.asc(bucket)
    earlier = Window.partitionBy(*groups).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*groups, bucket)
        .agg(*[F.sum(m).alias(f"_sum_{name}") for name, m in measures.items()])
        .select(
            *groups,
            bucket,
            *[
                F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
                for name in measures
            ],
        )
    )
    inside = (
        Window.partitionBy(*groups, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Null-safe, so that a NULL group finds its offsets as well.
    renamed = {c: f"_of_{c}" for c in [*groups, bucket]}
    before = before.withColumnsRenamed(renamed)
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other)) for c, other in renamed.items()]
    )
    return (
        df.join(before, same, "left")
        .drop(*renamed.values())
        .withColumns(
            {
                name: F.col(f"_before_{name}") + F.sum(m).over(inside)
                for name, m in measures.items()
            }
        )
        .drop(bucket, *[f"_before_{name}" for name in measures])
    )


def running_totals(
    distinct: DataFrame,
    groups: Sequence[str],
    order_column: str,
    measures: dict[str, Column],
    descending: bool = False,
    edges: Sequence[float] | None = None,
    rows_per_window: int = ROWS_PER_WINDOW,
) -> DataFrame:
    """Running sums per group over a table that has one row per (group, order value).

    Pass ``edges`` when they are known from a smaller table with the same values.
    """
    distinct = distinct.where(F.col(order_column).isNotNull())
    if edges is None:
        edges = bucket_edges(distinct, order_column, rows_per_window)
    order = F.desc(order_column) if descending else F.asc(order_column)
    return running_totals_in_buckets(
        with_bucket(distinct, order_column, edges), groups, "_bucket", [order], measures, descending
    )


def dense_index(df: DataFrame, h: Column, id_column: str, name: str = "row_idx") -> DataFrame:
    """Gap-free numbers from 0 in the order of a hash, ties by id."""
    bits = hash_bucket_bits(df.count())
    bucketed = df.withColumn("_h", h).withColumn("_bucket", hash_bucket(F.col("_h"), bits))
    return (
        running_totals_in_buckets(
            bucketed, [], "_bucket", [F.asc("_h"), F.asc(id_column)], {name: F.lit(1)}
        )
        .withColumn(name, (F.col(name) - 1).cast("bigint"))
        .drop("_h")
    )


def order_code(x: Column) -> Column:
    """A 64-bit integer that orders like a double: its bits, negated for negative numbers.

    The bits are made by arithmetic that is exact: scaling by powers of two. NaN comes last, as it
    does in Spark's own order, and both zeros are one.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("double")

    def scaled(e: Column) -> Column:
        return F.when(e >= 0, size / F.pow(F.lit(2.0), e)).otherwise(size * F.pow(F.lit(2.0), -e))

    # The logarithm is rounded, so the exponent may be off by one.
    exponent = (
        F.when(scaled(guess) >= 2, guess + 1).when(scaled(guess) < 1, guess - 1).otherwise(guess)
    )
    half = F.lit(2.0**537)
    bits = (
        F.when(F.isnan(x), F.lit((2047 << 52) + 1))
        .when(size == math.inf, F.lit(2047 << 52))
        .when(size < 2.0**-1022, (size * half * half).cast("long"))
        .otherwise((exponent + 1023).cast("long") * (1 << 52)
                   + ((scaled(exponent) - 1) * (1 << 52)).cast("long"))
    )
    return F.when(x < 0, -bits).otherwise(bits)


def code_value(code: int) -> float:
    """The double of an :func:`order_code`."""
    value = struct.unpack("<d", struct.pack("<q", abs(code)))[0]
    return -value if code < 0 else value


def digit_counts(
    codes: DataFrame, ranges: Sequence[tuple[int, int, int]], shift: int
) -> DataFrame:
    """``column, digit, n``: rows in each of ``ranges`` of codes by their next digit.

    A range is a column and the leading bits of a code, given as (column, bits to drop, prefix);
    a digit is all of a code but its last ``shift`` bits. Only counts are shuffled.
    """
    inside = reduce(
        lambda a, b: a | b,
        [(F.col("column") == c) & (F.shiftright("code", d) == p) for c, d, p in ranges if d < 64]
        or [F.lit(True)],
    )
    digit = F.shiftright("code", shift).alias("digit") if shift else F.col("code").alias("digit")
    return (
        codes.where(inside).groupBy("column", digit).agg(F.count("*").cast("long").alias("n"))
    )


def select_ranks(
    codes: DataFrame,
    columns: int,
    ranks: Callable[[int, int], Sequence[int]],
    limit: int = COUNTS_PER_PASS,
) -> dict[int, dict[int, int]]:
    """Codes at given ranks of several columns, by radix selection: column -> rank -> code.

    ``codes(column, code)`` has a row per value, ``ranks(column, rows)`` says which ranks from 0
    are wanted. A pass counts the rows of the ranges that hold a wanted rank by their next bits,
    as many bits as give ``limit`` counts at most, and leaves one narrower range per rank. Ranges
    with few rows are counted code by code at once. Values are never sorted, and equal ones, as
    many as there may be, are one count.
    """
    # (column, bits to drop, prefix) of a range -> ranks wanted in it, counted from its first row
    open_ranges: dict[tuple[int, int, int], list[tuple[int, int]]] = {
        (c, 64, 0): [] for c in range(columns)
    }
    found: dict[int, dict[int, int]] = {c: {} for c in range(columns)}
    left, rows = 64, None
    while open_ranges:
        bits = max(1, int(math.log2(max(2, limit / len(open_ranges)))))
        shift = 0 if rows is not None and rows <= limit else max(0, left - bits)
        counted = digit_counts(codes, list(open_ranges), shift).collect()
        per_range: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for r in counted:
            prefix = r["digit"] >> (left - shift) if left < 64 else 0
            per_range.setdefault((r["column"], left, prefix), []).append((r["digit"], r["n"]))
        narrower: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        rows = 0
        for key, wanted in open_ranges.items():
            digits = sorted(per_range.get(key, []))
            ends = list(accumulate(n for _, n in digits))
            if left == 64:
                total = ends[-1] if ends else 0
                wanted = [(k, k) for k in sorted(set(ranks(key[0], total))) if 0 <= k < total]
            for rank, inside in wanted:
                at = bisect.bisect_right(ends, inside)
                digit, n = digits[at]
                if shift == 0:
                    found[key[0]][rank] = digit
                    continue
                name = (key[0], shift, digit)
                if name not in narrower:
                    narrower[name] = []
                    rows += n
                narrower[name].append((rank, inside - (ends[at] - n)))
        open_ranges, left = narrower, shift
    return found


def exact_quantiles_of(
    df: DataFrame, shares: dict[str, Sequence[float]], limit: int = COUNTS_PER_PASS
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation of several columns, all in the same passes.

    The columns' codes are written once, eight bytes a value, and each pass reads them. NULL
    values are left out; a column without values has NULL quantiles.
    """
    names = list(shares)
    values = [
        F.struct(F.lit(i).alias("column"), order_code(F.col(c).cast("double")).alias("code"))
        for i, c in enumerate(names)
    ]
    codes = df.select(F.explode(F.array(*values)).alias("v")).select("v.column", "v.code")
    codes = materialize(codes.where(F.col("code").isNotNull()), "codes")
    sizes: dict[int, int] = {}

    def wanted(column: int, rows: int) -> list[int]:
        sizes[column] = rows
        ends = [(rows - 1) * s for s in shares[names[column]]]
        return [f(p) for p in ends for f in (math.floor, math.ceil)]

    found = select_ranks(codes, len(names), wanted, limit)
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        out[name] = []
        for share in shares[name]:
            position = (sizes.get(i, 0) - 1) * share
            if not sizes.get(i):
                out[name].append(None)
                continue
            low, high = (code_value(found[i][f(position)]) for f in (math.floor, math.ceil))
            out[name].append(low + (high - low) * (position - math.floor(position)))
    return out


def exact_quantiles(
    df: DataFrame, value: str, shares: Sequence[float], limit: int = COUNTS_PER_PASS
) -> DataFrame:
    """Quantiles with linear interpolation, as one row with an array column ``quantiles``."""
    found = exact_quantiles_of(df, {value: shares}, limit)[value]
    return df.sparkSession.createDataFrame([(found,)], "quantiles array<double>")


def average_ranks(counts: DataFrame, value: str, groups: Sequence[str], weight: str) -> DataFrame:
    """Ranks of distinct values per group, ties sharing their mean rank.

    ``counts`` has one row per group and value, with the number of rows in ``weight``; its other
    columns are kept. ``centered_rank`` is the distance from the mean rank of the group: half the
    rows below minus half the rows above, which needs no group total and is exactly 0 for a
    constant.
    """
    edges = bucket_edges(counts, value)
    n = F.col(weight)
    upward = running_totals(counts, groups, value, {"_upto": n}, edges=edges)
    both = running_totals(upward, groups, value, {"_from": n}, descending=True, edges=edges)
    return both.withColumns(
        {
            "rank": F.col("_upto") - (n - 1) / 2.0,
            "centered_rank": (F.col("_upto") - F.col("_from")) / 2.0,
        }
    ).drop("_upto", "_from")


class TooManyStrata(ValueError):
    """More strata than are looked at on the driver."""


def cutoff_table(
    df: DataFrame, stratum: str, h: Column, id_column: str, ranks: Callable[[Column], Column]
) -> DataFrame:
    """``stratum, n, cuts`` for any number of strata: of each its rows and the rows at given ranks
    in the order of hash, then id, as (hash, id).

    ``ranks`` makes an array of ranks from 1, ascending, of the number of rows. Rows are counted by
    stratum and hash bucket; only the buckets that hold a wanted rank are looked into. Nothing is
    collected: a stratum has at most as many buckets as there are, whatever its size.
    """
    bits = hash_bucket_bits(df.count())
    keyed = df.select(
        F.col(stratum).alias("stratum"), h.alias("h"), F.col(id_column).alias("id")
    ).withColumn("bucket", hash_bucket(F.col("h"), bits))
    own = Window.partitionBy("stratum")
    before = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    n, first = F.col("n"), F.col("before")
    buckets = (
        keyed.where(F.col("stratum").isNotNull())
        .groupBy("stratum", "bucket")
        .agg(F.count("*").alias("rows"))
        .withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn("n", F.sum("rows").over(own))
        .withColumn("here", F.filter(ranks(n), lambda r: (r > first) & (r <= first + F.col("rows"))))
        .withColumn("places", F.transform("here", lambda r: r - first))
    )
    buckets = materialize(buckets.select("stratum", "bucket", "n", "places"), "buckets")
    wanted = buckets.where(F.size("places") > 0)
    place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "id"))
    cuts = (
        keyed.join(wanted.select("stratum", "bucket", "places"), ["stratum", "bucket"])
        .withColumn("place", place)
        .where(F.array_contains("places", F.col("place").cast("long")))
        .groupBy("stratum")
        .agg(F.array_sort(F.collect_list(F.struct("h", "id"))).alias("cuts"))
    )
    sizes = buckets.groupBy("stratum").agg(F.max("n").alias("n"))
    return sizes.join(cuts, "stratum", "left")


def hash_cutoffs(
    df: DataFrame, stratum: str | None, h: Column, id_column: str,
    ranks: Callable[[object, int], Sequence[int]],
) -> dict[object, list[tuple[int, object]]]:
    """For each stratum the rows that hold given ranks when ordered by hash, then id.

    ``ranks(stratum, rows)`` says which ranks (from 1). Two passes and no shuffle of the data:
    the first counts rows per hash bucket, the second looks only into the buckets that hold a
    wanted rank. The driver sees one count per bucket and stratum, and strata are limited.
    """
    stratum_column = F.lit(0) if stratum is None else F.col(stratum)
    bits = hash_bucket_bits(df.count())
    keyed = df.select(
        stratum_column.alias("stratum"), h.alias("h"), F.col(id_column).alias("id")
    ).withColumn("bucket", hash_bucket(F.col("h"), bits))
    limit = MAX_STRATA << bits
    counts = keyed.groupBy("stratum", "bucket").count().limit(limit + 1).collect()
    if len(counts) > limit:
        raise TooManyStrata(f"{stratum!r} has more than {MAX_STRATA} strata")

    per_stratum: dict[object, list] = {}
    for row in sorted(counts, key=lambda r: r["bucket"]):
        per_stratum.setdefault(row["stratum"], []).append((row["bucket"], row["count"]))
    wanted: list[tuple[object, int, int, int]] = []
    for value, buckets in per_stratum.items():
        ends, seen = [], 0
        for _, n in buckets:
            seen += n
            ends.append(seen)
        for rank in sorted(set(ranks(value, seen))):
            if 1 <= rank <= seen:
                at = bisect.bisect_left(ends, rank)
                before = ends[at] - buckets[at][1]
                wanted.append((value, rank, buckets[at][0], rank - before))
    if not wanted:
        return {value: [] for value in per_stratum}

    def is_wanted(columns: Sequence[str], position: Callable) -> Column:
        return reduce(
            lambda a, b: a | b,
            [
                reduce(
                    lambda a, b: a & b,
                    [F.col(c) == F.lit(v) for c, v in zip(columns, position(w), strict=True)],
                )
                for w in wanted
            ],
        )

    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("h", "id")
    found = (
        keyed.where(is_wanted(["stratum", "bucket"], lambda w: (w[0], w[2])))
        .withColumn("place", F.row_number().over(in_bucket))
        .where(is_wanted(["stratum", "bucket", "place"], lambda w: (w[0], w[2], w[3])))
        .collect()
    )
    result: dict[object, list[tuple[int, object]]] = {value: [] for value in per_stratum}
    for row in sorted(found, key=lambda r: (r["h"], r["id"])):
        result[row["stratum"]].append((row["h"], row["id"]))
    return result


def after_cutoff(h: Column, id_column: str, cutoff: tuple[int, object]) -> Column:
    """Whether a row comes strictly after a cutoff row."""
    cut_h, cut_id = cutoff
    return (h > F.lit(cut_h)) | ((h == F.lit(cut_h)) & (F.col(id_column) > F.lit(cut_id)))
