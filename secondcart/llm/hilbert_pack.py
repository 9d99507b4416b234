"""Packing documents into fixed-length sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns, text_slices
from secondcart.llm.tokens import word_tokenizer
from secondcart.sources.writers import materialize

SEQUENCE = 4096
SEED = 42
HASHED = 1 << 12
DIMENSIONS = 3
LEVEL_BITS = 13
# Low bits of a sort key: documents at one point of the curve, such as copies, are told apart by
# a hash, so that no point is too heavy for one partition. 52 bits in all are exact as a double.
SPREAD_BITS = 52 - DIMENSIONS * LEVEL_BITS
# Coordinates are means of zero-mean weights; this many standard deviations span the grid.
SPAN = 4.0


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points, ``(n, d)`` with ``bits`` per axis.

    Works on all points at once: undoes the curve's rotations from the highest bit down, Gray
    decodes, then interleaves the bits of the axes.
    """
    x = [grid[:, k].astype(np.int64) for k in range(grid.shape[1])]
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for k in range(d):
            high = (x[k] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        level >>= 1
    for k in range(1, d):
        x[k] = x[k] ^ x[k - 1]
    turned = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turned = np.where(x[-1] & level, turned ^ (level - 1), turned)
        level >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(d):
            key = (key << 1) | (((x[k] ^ turned) >> b) & 1)
    return key


def projection(n_ids: int, seed: int) -> np.ndarray:
    """Per token id its weight in each dimension: ids are hashed into ``HASHED`` features, and
    features are projected by a seeded Gaussian matrix."""
    hashed = (np.arange(n_ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    sign = np.where((hashed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(63), -1.0, 1.0)
    matrix = np.random.default_rng(seed).standard_normal((HASHED, DIMENSIONS))
    return (matrix[hashed % np.uint64(HASHED)] * sign[:, None]).astype(np.float32)


def curve_keys(ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hilbert key of every document from its token ids."""
    n = np.diff(offsets)
    filled = np.flatnonzero(n)
    means = np.zeros((len(n), DIMENSIONS))
    if len(filled):
        for k in range(DIMENSIONS):
            added = np.add.reduceat(weights[:, k][ids], offsets[filled], dtype=np.float64)
            means[filled, k] = added / n[filled]
    levels = 1 << LEVEL_BITS
    # A logistic squeeze keeps every document on the grid and spends most levels on the middle.
    placed = 1.0 / (1.0 + np.exp(-SPAN * means))
    grid = np.minimum((placed * levels).astype(np.int64), levels - 1)
    return hilbert_key(grid, LEVEL_BITS)


def _tokens(batches, vocabulary: str, end_id: int, seed: int) -> Iterator[pa.RecordBatch]:
    tokenizer = word_tokenizer(vocabulary)
    weights = projection(len(tokenizer.ends), seed)
    end = np.array([end_id], dtype=tokenizer.dtype)
    for batch in text_slices(batches):
        ids, offsets = tokenizer.encode(batch.column("text"))
        keys = curve_keys(ids, offsets, weights)
        whole = [
            np.concatenate([ids[a:b], end]).tobytes()
            for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                pa.array(whole, pa.binary()),
                pa.array(np.diff(offsets) + 1),
                pa.array(keys),
            ],
            names=["row", "doc_id", "ids", "n", "curve"],
        )


def _pieces(batches, starts: list[int], width: int, length: int) -> Iterator[pa.RecordBatch]:
    kind = f"<u{width}"
    at: dict[int, int] = {}
    for batch in batches:
        columns: list[list[int]] = [[] for _ in range(6)]
        owners = []
        rows = zip(
            batch.column("stretch").to_pylist(), batch.column("ids").to_pylist(), strict=True
        )
        for i, (stretch, raw) in enumerate(rows):
            position = at.get(stretch, starts[stretch])
            ids = np.frombuffer(raw, kind).astype("<u4")
            done = 0
            while done < len(ids):
                offset = (position + done) % length
                size = min(length - offset, len(ids) - done)
                crc = zlib.crc32(ids[done : done + size].tobytes())
                piece = (done, size, crc, len(ids), (position + done) // length, offset)
                for column, value in zip(columns, piece, strict=True):
                    column.append(value)
                owners.append(i)
                done += size
            at[stretch] = position + len(ids)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(owners, pa.int64())),
                *(pa.array(c, pa.int64()) for c in columns),
            ],
            names=[x.split()[0] for x in PIECES.split(", ")],
        )


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long"
)
# Steps of the curve for each stretch.
STEPS_PER_PARTITION = 16


def even_stretches(sizes: list[int], n: int) -> tuple[list[int], list[int]]:
    """Join neighbouring steps into at most ``n`` stretches of about equal size: where each
    stretch starts, and the stretch of each step."""
    total = sum(sizes)
    starts: list[int] = []
    of, at, last = [], 0, -1
    for size in sizes:
        share = min(n - 1, (2 * at + size) * n // (2 * total)) if total else 0
        if share != last:
            starts.append(at)
            last = share
        of.append(len(starts) - 1)
        at += size
    return starts, of


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    length: int = SEQUENCE,
    seed: int = SEED,
) -> DataFrame:
    """Pieces of all documents, laid end to end along the curve and cut every ``length`` tokens.

    Every document becomes its token ids and ``end_id``. Its hashed token counts are projected to
    ``DIMENSIONS`` coordinates, whose place on a Hilbert curve is its sort key: documents with
    similar words lie near each other and share sequences. The curve is cut into small steps with
    equally many documents each, and neighbouring steps form as many stretches as there are
    shuffle partitions, with equally many tokens; a stretch's tokens begin where those of the
    stretches before it end. Limits and sizes of steps are all that the driver gets to know. So only the last sequence of all has
    padding, and each task packs its stretch alone. Token ids are written once to the shared
    folder and cross the network once.

    Rows are told apart by a number of their own, so NULL and repeated ids do no harm: each row
    is a document. A NULL text is empty, a document of the end id alone. Other columns are
    ignored. An empty table has no pieces.
    """
    spark = docs.sparkSession
    rows = exact_columns(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
    )
    encoded = materialize(
        rows.mapInArrow(
            lambda batches: _tokens(batches, vocabulary, end_id, seed),
            "row long, doc_id long, ids binary, n long, curve long",
        ),
        "token-ids",
    )
    spread = F.shiftrightunsigned(F.xxhash64("row"), 64 - SPREAD_BITS)
    keyed = encoded.withColumn("key", F.shiftleft("curve", SPREAD_BITS).bitwiseOR(spread))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = n * STEPS_PER_PARTITION
    shares = [k / fine for k in range(1, fine)]
    found = keyed.agg(F.percentile_approx("key", shares, max(10_000, 20 * fine))).first()[0]
    # One step alone gets a limit above every key.
    limits = sorted(set(found or [])) or [1 << 62]
    splits = [-float("inf"), *map(float, limits), float("inf")]
    step = Bucketizer(splits=splits, inputCol="key", outputCol="place")
    placed = step.transform(keyed).withColumn("step", F.col("place").cast("int"))
    totals = dict(placed.groupBy("step").agg(F.sum("n")).collect())
    starts, stretch_of = even_stretches([totals.get(k, 0) for k in range(len(splits) - 1)], n)
    width = np.dtype(word_tokenizer(vocabulary).dtype).itemsize
    return (
        placed.withColumn("stretch", F.get(F.lit(stretch_of), F.col("step")))
        .select("stretch", "key", "row", "doc_id", "ids")
        .repartitionById(len(starts), F.col("stretch"))
        .sortWithinPartitions("stretch", "key", "row")
        .mapInArrow(lambda batches: _pieces(batches, starts, width, length), PIECES)
    )
