"""Importance resampling towards a target text: hashed n-gram counts from overlapped regex scans.

Separators become single blanks, so that the words of a text are the runs between blanks. One
pattern, scanned with overlapping matches between boundaries, gives at every word the ends of the
runs of one, two and three words that start there; a CRC is carried from one end to the next.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns, offsets_of, sums, text_slices
from secondcart.llm.rows import ROW, identified
from secondcart.sources.writers import materialize

BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
PERCENT = 5
# A run of up to three words from one boundary to another: its end and those of its first and
# first two words. Runs never give characters back, so a scan takes time in proportion to the text.
RUNS = rb"(?<![^ ])(([^ ]++)(?: [^ ]++)?+)(?: [^ ]++)?+(?![^ ])"
LETTERS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
# Lower-cases A-Z and turns all other ASCII characters but digits and letters into blanks; the
# bytes of other characters stay, and none of them is an ASCII byte.
TABLE = bytes(
    32 if c < 128 and c not in LETTERS else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
FEATURES = "row long, doc_id long, n_words long, n_features long, buckets binary"


def collapsed(text: bytes) -> bytes:
    """Words of a text with single blanks between them."""
    return b" ".join(text.translate(TABLE).split())


def scanner():
    import regex

    return regex.compile(RUNS).finditer


def feature_hashes(line: bytes, scan) -> tuple[np.ndarray, int]:
    """CRC-32 of every run of one to three words of a collapsed text, and its number of words."""
    hashes = array("I")
    add = hashes.append
    n_words = 0
    for found in scan(line, overlapped=True):
        (start, three), (_, two), (_, one) = found.regs
        n_words += 1
        crc = crc32(line[start:one])
        add(crc)
        if two > one:
            crc = crc32(line[one:two], crc)
            add(crc)
            if three > two:
                add(crc32(line[two:three], crc))
    return np.frombuffer(hashes, np.uint32), n_words


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def features(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Buckets of all features of ``texts(row, doc_id, text)``, packed, one row per text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        scan, kind = scanner(), _kind(buckets)
        for batch in text_slices(batches):
            packed, n_words, n_features = [], [], []
            for text in batch.column("text"):
                hashes, n = feature_hashes(collapsed((text.as_py() or "").encode()), scan)
                packed.append((hashes % np.uint32(buckets)).astype(kind).tobytes())
                n_words.append(n)
                n_features.append(len(hashes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_features, pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                names=["row", "doc_id", "n_words", "n_features", "buckets"],
            )

    return texts.mapInArrow(run, FEATURES)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of the whole table in each bucket. Tasks count on their own first,
    so at most ``buckets`` rows of each are shuffled."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                own = np.frombuffer(packed.as_buffer(), _kind(buckets))
                counts += np.bincount(own, minlength=buckets)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int32()), pa.array(counts[filled])], names=["bucket", "n"]
        )

    parts = found.select("buckets").mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and source shares, floored, per bucket."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left"
    )
    counts = np.zeros((2, buckets), np.int64)
    for r in counted.where("s is not null or t is not null").collect():
        counts[:, r["bucket"]] = r["s"] or 0, r["t"] or 0
    (s, t), (all_s, all_t) = counts.astype(np.float64), counts.sum(axis=1).tolist()
    ratio = (t + 1) * float(all_s + buckets) / ((s + 1) * float(all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight`` with the sum of the gains of each text's features."""
    kind = _kind(len(gains))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "buckets"):
            packed = batch.column("buckets")
            own = np.frombuffer(b"".join(packed.to_pylist()), kind)
            offsets = offsets_of(batch.column("n_features").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    batch.column("n_features"),
                    pa.array(sums(gains[own], offsets)),
                ],
                names=["row", "doc_id", "n_words", "n_features", "weight"],
            )

    schema = "row long, doc_id long, n_words long, n_features long, weight long"
    return found.mapInArrow(run, schema)


def noise(seed: int, id_column: str):
    """Gumbel noise in thousandths, floored, from the first 8 hex digits of SHA-256(seed:id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` with ``rank``, 1 for the highest score; NULL beyond ``drawn``. Ties go to the
    smaller doc_id, then to the earlier row.

    Rows are cut into ranges of the whole order, so equal scores and ids do not meet in one task;
    the row counts of the ranges, one row each, say at which rank a range starts.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    cut = materialize(
        scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rank = (F.col("start") + F.col("place")).cast("long")
    return (
        cut.withColumn("place", place)
        .join(starts, "part")
        .withColumn("rank", F.when(rank <= drawn, rank))
        .drop("part", "place", "start")
    )


def _scores(
    rows: DataFrame, target: DataFrame, percent: int, min_words: int, buckets: int, seed: int
) -> DataFrame:
    """Of identified rows: row, doc_id, n_features, weight, score, rank."""
    texts = rows.select(
        F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    found = materialize(features(texts, buckets), "features")
    nothing = F.lit(None).cast("long")
    wanted = exact_columns(target, "text").select(
        nothing.alias("row"), nothing.alias("doc_id"), "text"
    )
    gains = bucket_gains(
        bucket_counts(found, buckets), bucket_counts(features(wanted, buckets), buckets), buckets
    )
    score = F.col("weight") + noise(seed, "doc_id")
    scored = materialize(weights(found, gains).withColumn("score", score), "scores")
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(able), drawn).unionByName(rest).drop("n_words")


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """How much every row of ``docs`` reads like ``target``, and the rank of those drawn: doc_id,
    n_features, weight, score, rank.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Features are all
    runs of one to three words, each in one of ``buckets`` by CRC-32. A bucket gains by how much
    larger its share is in the target than in the documents; a document's weight is the sum over
    its features, its score adds Gumbel noise made of its id, so that taking the highest scores
    draws without replacement in proportion to exp(weight / 1000). Of the rows with at least
    ``min_words`` words ``percent`` per cent are drawn.

    A NULL or empty text has no features and weight 0. Very long texts are scanned whole, four
    bytes a feature. Rows with the same id, or with none (its noise is that of an empty id), are
    ranked each for itself, in the order of their rows where all else is equal; repeated rows count
    as often as they occur. An empty table gives an empty result, an empty target has equal shares.
    Other columns are ignored, whatever their names.
    """
    rows = identified(exact_columns(docs, "doc_id", "text"))
    scored = _scores(rows, target, percent, min_words, buckets, seed)
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; see :func:`importance_ranks`."""
    rows = identified(docs)
    plain = exact_columns(rows, ROW, "doc_id", "text")
    scored = _scores(plain, target, percent, min_words, buckets, seed)
    drawn = scored.where(F.col("rank").isNotNull()).select(F.col("row").alias(ROW))
    names = rows.columns[1:]
    numbered = rows.toDF(ROW, *[f"_{i}" for i in range(len(names))])
    return numbered.join(drawn, ROW, "left_semi").drop(ROW).toDF(*names)
