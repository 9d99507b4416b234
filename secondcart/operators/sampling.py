"""Splits, folds, samples and bootstrap draws that depend only on a seed and a row's key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from secondcart.functions.hashing import hash32
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.operators.order_stats import (
    TooManyStrata,
    after_cutoff,
    cutoff_table,
    dense_index,
    hash_cutoffs,
)
from secondcart.sources.writers import materialize

# Cells between which draws are split together, and children of a node above them.
BLOCK_CELLS = 1 << 14
FAN_OUT = 64
OUTPUT_ROWS = 100_000
# Cells of a block times replicates that are drawn at a time.
DRAWN_AT_ONCE = 1 << 20


def _per_stratum(stratum: str, cutoffs: dict, expression: Callable) -> Column:
    """One literal expression per stratum, chosen by the value of the stratum column."""
    branches = [(F.col(stratum) == F.lit(v), expression(cuts)) for v, cuts in cutoffs.items()]
    if not branches:
        return F.lit(None)
    chosen = F.when(*branches[0])
    for branch in branches[1:]:
        chosen = chosen.when(*branch)
    return chosen


def _with_cuts(
    df: DataFrame, dealt: DataFrame, stratum: str, h: Column, id_column: str,
    ranks: Callable[[Column], Column],
) -> DataFrame:
    """``df`` with ``_cuts``, the cutoffs of each row's stratum among the rows of ``dealt``, from
    a table that is joined."""
    table = cutoff_table(dealt, stratum, h, id_column, ranks).withColumnsRenamed(
        {"stratum": stratum, "n": "_n", "cuts": "_cuts"}
    )
    return lookup_by_hot_key(df, table, stratum, "_n").drop("_n")


def _cuts_before(h: Column, id_column: str) -> Column:
    """How many of a row's cutoffs come strictly before it; a stratum without any has none."""
    own = F.struct(h.alias("h"), F.col(id_column).alias("id"))
    before = F.size(F.filter("_cuts", lambda c: c < own))
    return F.when(F.col("_cuts").isNull(), 0).otherwise(before)


def stratified_split(
    df: DataFrame, id_column: str, stratum: str, share: float, seed: int, tag: str = "split"
) -> DataFrame:
    """Add ``split``: ``test`` for ``share`` of each stratum (rounded), else ``train``.

    The rows of a stratum are ordered by a hash of their key; the first ones are the test set.
    Only the cutoff of each stratum is computed: a literal for each of a few strata, so that the
    data are not moved, or a table that is joined where there are many.
    """
    h = hash32(seed, tag, id_column)
    try:
        cutoffs = hash_cutoffs(
            df, stratum, h, id_column, lambda _, n: [math.floor(share * n + 0.5)]
        )
    except TooManyStrata:
        joined = _with_cuts(
            df, df, stratum, h, id_column,
            lambda n: F.array(F.floor(n * F.lit(share) + 0.5).cast("long")),
        )
        # Without a cutoff the share rounds to no row of the stratum.
        no_cut = F.col("_cuts").isNull() & F.col(stratum).isNotNull()
        is_train = no_cut | (_cuts_before(h, id_column) > 0)
        split = F.when(is_train, "train").otherwise("test")
        return joined.select(*df.columns, split.alias("split"))
    is_train = _per_stratum(
        stratum,
        cutoffs,
        lambda cuts: after_cutoff(F.col("_h"), id_column, cuts[0]) if cuts else F.lit(True),
    )
    # The hash is a column of its own, so that it is computed once per row.
    split = F.when(is_train, "train").otherwise("test")
    return df.withColumn("_h", h).withColumn("split", split).drop("_h")


def _tile_ends(n: int, tiles: int) -> list[int]:
    """Last rank of every tile but the last, for tiles as even as possible."""
    sizes = [n // tiles + (i < n % tiles) for i in range(tiles)]
    return [sum(sizes[: i + 1]) for i in range(tiles - 1)]


def _tile_end_columns(n: Column, tiles: int) -> Column:
    whole, rest = F.floor(n / tiles), n % tiles
    return F.array(*[(i * whole + F.least(F.lit(i), rest)).cast("long") for i in range(1, tiles)])


def stratified_folds(
    df: DataFrame,
    id_column: str,
    stratum: str,
    folds: int,
    seed: int,
    tag: str = "fold",
    within: Column | None = None,
) -> DataFrame:
    """Add ``fold`` (0..folds-1): each stratum is cut into folds that differ by at most one row.

    With ``within`` only those rows are dealt out; the others get NULL.
    """
    h = hash32(seed, tag, id_column)
    dealt = df if within is None else df.where(within)
    try:
        cutoffs = hash_cutoffs(dealt, stratum, h, id_column, lambda _, n: _tile_ends(n, folds))
    except TooManyStrata:
        joined = _with_cuts(
            df, dealt, stratum, h, id_column, lambda n: _tile_end_columns(n, folds)
        )
        fold = F.when(F.col(stratum).isNotNull(), _cuts_before(h, id_column))
        if within is not None:
            fold = F.when(within, fold)
        return joined.select(*df.columns, fold.cast("int").alias("fold"))
    fold = _per_stratum(
        stratum,
        cutoffs,
        lambda cuts: reduce(
            lambda a, b: a + b,
            [after_cutoff(F.col("_h"), id_column, c).cast("int") for c in cuts],
            F.lit(0),
        ),
    )
    if within is not None:
        fold = F.when(within, fold)
    return df.withColumn("_h", h).withColumn("fold", fold.cast("int")).drop("_h")


def hash_sample(
    df: DataFrame, id_column: str, rows: int, seed: int, tag: str = "sample"
) -> DataFrame:
    """A fixed number of rows without replacement (all rows when there are fewer)."""
    h = hash32(seed, tag, id_column)
    cuts = hash_cutoffs(df, None, h, id_column, lambda _, n: [min(rows, n)]).get(0, [])
    if not cuts:
        return df
    return df.withColumn("_h", h).where(~after_cutoff(F.col("_h"), id_column, cuts[0])).drop("_h")


def split_uniforms(seed: int, replicates: np.ndarray, block: int, nodes: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for every node that is split, two of them from one MD5."""
    if not len(nodes):
        return np.zeros(0)
    pair = nodes >> 1
    # Neighbours come one after the other, so their digest is made once.
    new = np.ones(len(nodes), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (replicates[1:] != replicates[:-1])
    digests = b"".join(
        md5(f"{seed}|split|{r}|{block}|{v}".encode()).digest()
        for r, v in zip(replicates[new].tolist(), pair[new].tolist(), strict=True)
    )
    first, second = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
    # Hexadecimal digits 1 to 15, and 16 to 30.
    odd = ((first & np.uint64(15)) << np.uint64(56)) | (second >> np.uint64(8))
    own = np.cumsum(new) - 1
    return np.where(nodes & 1, odd[own], (first >> np.uint64(4))[own]) / float(1 << 60)


def binomial_inverse(
    draws: np.ndarray, share: np.ndarray, u: np.ndarray, log_factorial: np.ndarray
) -> np.ndarray:
    """The smallest k whose binomial distribution function exceeds ``u``, for each of many.

    The search starts ten standard deviations below the mean, where nothing has been left out
    that a double could tell.
    """
    with np.errstate(divide="ignore"):
        log_p, log_q = np.log(share), np.log1p(-share)

    def mass(at: np.ndarray, k: np.ndarray) -> np.ndarray:
        n = draws[at]
        ways = log_factorial[n] - log_factorial[k] - log_factorial[n - k]
        return np.exp(ways + k * log_p[at] + (n - k) * log_q[at])

    out = np.where(share >= 1, draws, 0)
    at = np.flatnonzero((share > 0) & (share < 1))
    mean = draws[at] * share[at]
    low = mean - 10 * np.sqrt(mean * (1 - share[at])) - 20
    k = np.maximum(np.floor(low), 0).astype(np.int64)
    total = mass(at, k)
    while len(at):
        out[at] = k
        more = np.flatnonzero((total <= u[at]) & (k < draws[at]))
        at, k = at[more], k[more] + 1
        total = total[more] + mass(at, k)
    return out


def split_draws(
    weights: np.ndarray, replicates: np.ndarray, draws: np.ndarray, seed: int, block: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(replicate, place, n)``: draws of each replicate dealt out to weighted places.

    A balanced tree over the places is split from its root: the draws of a node go to the left
    with the share of the left weight, binomially. Nodes without draws are not visited, so a
    replicate costs about as much as it has different places, however many draws there are.
    """
    depth = max(0, int(len(weights) - 1).bit_length())
    padded = np.zeros(1 << depth, np.int64)
    padded[: len(weights)] = weights
    before = np.concatenate([[0], np.cumsum(padded)])
    log_factorial = np.array([math.lgamma(i + 1) for i in range(int(draws.max(initial=0)) + 1)])
    node = np.ones(len(replicates), np.int64)
    for level in range(depth):
        width = 1 << (depth - level)
        start = (node - (1 << level)) * width
        left = before[start + width // 2] - before[start]
        share = left / (before[start + width] - before[start])
        u = split_uniforms(seed, replicates, block, node)
        k = binomial_inverse(draws, share, u, log_factorial)
        node = np.stack([2 * node, 2 * node + 1], axis=1).ravel()
        draws = np.stack([k, draws - k], axis=1).ravel()
        replicates = np.repeat(replicates, 2)
        some = np.flatnonzero(draws)
        node, draws, replicates = node[some], draws[some], replicates[some]
    return replicates, node - (1 << depth), draws


def draws_per_block(
    blocks: DataFrame, rows: int, replicates: int, seed: int, fan_out: int = FAN_OUT
) -> DataFrame:
    """``(replicate, block, draws)``: how many of a replicate's draws fall into each block of
    ``blocks(block, weight)``, a seeded multinomial.

    The upper part of the tree, ``fan_out`` children to a node. Its weights are a table per level
    that is joined; no list of blocks is held anywhere.
    """
    spark = blocks.sparkSession
    levels = [blocks.select(F.col("block").alias("node"), "weight")]
    height = math.ceil(math.log(max(levels[0].count(), 1), fan_out) - 1e-9)
    for _ in range(height):
        up = F.expr(f"node div {fan_out}").alias("node")
        levels.append(levels[-1].groupBy(up).agg(F.sum("weight").alias("weight")))
    dealt = spark.range(replicates).select(
        F.col("id").cast("int").alias("replicate"),
        F.lit(0).cast("long").alias("node"),
        F.lit(rows).cast("long").alias("draws"),
    )

    def deal(level: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                parts = []
                for r, node, n, own in batch.itertuples(index=False):
                    children = np.array([c["child"] for c in own])
                    weight = np.array([c["weight"] for c in own], float)
                    rng = np.random.default_rng([seed, int(r), level, int(node)])
                    k = rng.multinomial(n, weight / weight.sum())
                    parts.append(pd.DataFrame({"replicate": r, "node": children, "draws": k}))
                if parts:
                    yield pd.concat(parts).astype({"replicate": np.int32})

        return run

    for level in range(height, 0, -1):
        child = F.struct(F.col("node").alias("child"), "weight")
        children = levels[level - 1].groupBy(F.expr(f"node div {fan_out}").alias("node")).agg(
            F.array_sort(F.collect_list(child)).alias("children")
        )
        dealt = (
            dealt.join(children, "node")
            .select("replicate", "node", "draws", "children")
            .mapInPandas(deal(level), "replicate int, node long, draws long")
            .where("draws > 0")
        )
    return dealt.withColumnRenamed("node", "block")


# Makes of a block's values a function that makes batches of ``(replicate, place, draws)``.
Made = Callable[[pa.Array], Callable[..., Iterator[pa.RecordBatch]]]


def _each_draw(values: pa.Array) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A row for each replicate and cell that it draws."""

    def made(
        replicate: np.ndarray, place: np.ndarray, n: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(place), OUTPUT_ROWS):
            part = slice(a, a + OUTPUT_ROWS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(replicate[part], pa.int32()),
                    values.take(pa.array(place[part])),
                    pa.array(n[part]),
                ],
                names=["replicate", "value", "draws"],
            )

    return made


def bootstrap_counts(
    cells: DataFrame,
    first_id: str,
    weight: str,
    value: str,
    replicates: int,
    seed: int,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``(replicate, value, draws)``: how often each replicate draws each cell."""
    schema = StructType().add("replicate", "integer")
    schema = schema.add("value", cells.schema[value].dataType).add("draws", "long")
    return drawn_by_block(
        cells, first_id, weight, value, replicates, seed, block_cells, _each_draw, schema
    ).withColumnRenamed("value", value)


def drawn_by_block(
    cells: DataFrame,
    first_id: str,
    weight: str,
    value: str,
    replicates: int,
    seed: int,
    block_cells: int,
    make: Made,
    schema: StructType,
) -> DataFrame:
    """What ``make`` makes of how often each replicate draws each cell of a block.

    ``cells`` has one row per different ``value``, with the number of rows that have it in
    ``weight`` and one of their ids; a replicate has as many draws as there are rows, with
    replacement. Cells are numbered in the order of a hash of the id and cut into blocks. Draws
    are dealt to blocks, and in a block to its cells, by splitting a tree, so that a cell of very
    many rows costs what any other does and only cells that are drawn make a row.
    """
    numbered = materialize(
        dense_index(cells, hash32(seed, "row", first_id), first_id).select(
            F.expr(f"row_idx div {block_cells}").alias("block"),
            (F.col("row_idx") % block_cells).cast("int").alias("place"),
            F.col(weight).cast("long").alias("weight"),
            F.col(value).alias("value"),
        ),
        "cells",
    )
    totals = numbered.groupBy("block").agg(F.sum("weight").alias("weight"))
    rows = totals.agg(F.sum("weight")).first()[0] or 0
    spark = cells.sparkSession
    n_blocks = max(totals.count(), 1)
    # Few blocks are met by several groups of replicates, so that many tasks are busy.
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, math.ceil(wanted / n_blocks))
    listed = (
        draws_per_block(totals, rows, replicates, seed)
        .groupBy("block", (F.col("replicate") % groups).alias("group"))
        .agg(F.collect_list(F.struct("replicate", "draws")).alias("dealt"))
    )
    placed = numbered.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("place", "weight", "value"))).alias("own")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("own").slice(k, 1).flatten()
                dealt = batch.column("dealt").slice(k, 1).flatten()
                weights = own.field("weight").to_numpy()
                replicate = dealt.field("replicate").to_numpy().astype(np.int64)
                draws = dealt.field("draws").to_numpy()
                block = batch.column("block")[k].as_py()
                made = make(own.field("value"))
                step = max(1, DRAWN_AT_ONCE // len(weights))
                for a in range(0, len(replicate), step):
                    part = slice(a, a + step)
                    yield from made(*split_draws(weights, replicate[part], draws[part], seed, block))

    return (
        listed.join(placed, "block")
        .repartition(wanted, "block", "group")
        .select("block", "own", "dealt")
        .mapInArrow(run, schema)
    )
