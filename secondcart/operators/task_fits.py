"""Ensembles of trees that are grown whole in tasks, many fits side by side.

A fit of a few hundred trees is a chain of thousands of small passes. As long as the coded rows of a
fit are small beside a task's memory, they are dealt to the task that grows its trees, and a search is
as many tasks as it has fits: a boosted ensemble is one task, a forest one for every few trees. Tables
of more rows are left to :mod:`joint_boosting` and :mod:`deep_forest`, whose trees these are: the same
codes, draws, splits and leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.operators import joint_boosting as jb
from secondcart.operators.deep_forest import (
    CODES,
    DeepForest,
    bin_edges,
    draws,
    grown_below,
    uniforms,
)
from secondcart.sources.writers import materialize

# Rows up to which a fit is grown whole in a task: about 100 bytes each while it grows.
FIT_ROWS = 1_000_000
# Trees of a forest that a task grows.
TREES_PER_TASK = 50
# Positive rows are counted above so many bits, beside all rows, in one sum.
COUNT_BITS = 26


@dataclass(frozen=True)
class Fit:
    """An ensemble that is fitted to all folds but the ``held`` one, whose rows it scores."""

    name: str
    columns: tuple[str, ...]
    ensemble: jb.Boosting | DeepForest
    held: int
    class_weights: tuple[float, float]


@dataclass(frozen=True)
class Coded:
    """Rows with the codes of every column by the edges of each held fold; ``row`` tells them apart."""

    rows: DataFrame
    held: tuple[int, ...]
    columns: tuple[str, ...]
    id_column: str
    fold_type: str


def coded(
    rows: DataFrame, columns: Sequence[str], held: Sequence[int], seed: int, id_column: str,
    label: str, fold: str,
) -> Coded:
    """The rows of all folds, coded and written."""
    inside = rows.where(F.col(fold).isNotNull())
    edges = [bin_edges(inside.where(F.col(fold) != k), columns) for k in held]
    plain = inside.select(
        F.col(id_column).alias("id"),
        F.col(label).cast("int").alias("label"),
        F.col(fold).cast("int").alias("fold"),
        F.xxhash64(F.lit(seed), F.col(id_column)).alias("h"),
        *[F.col(c).cast("double").alias(f"x{f}") for f, c in enumerate(columns)],
    )
    kind = plain.schema["id"].dataType.simpleString()
    found = plain.mapInArrow(
        jb.row_coder(edges, columns), f"id {kind}, label int, fold int, h long, codes binary"
    )
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    fold_type = rows.schema[fold].dataType.simpleString()
    return Coded(
        materialize(numbered, "coded"), tuple(held), tuple(columns), id_column, fold_type
    )


# --- rows of a fit ---------------------------------------------------------------------------


def _dealt(table: Coded, fits: Sequence[Fit], pieces: Sequence[tuple[int, int, int]]) -> DataFrame:
    """All rows once a piece, each piece in a partition of its own. A row has the codes of the
    piece's held fold, and its id only where it is to be scored."""

    def of_piece(values: Sequence[int]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("piece") + 1)

    width = len(table.columns)
    held = [fits[k].held for k, _, _ in pieces]
    starts = of_piece([table.held.index(h) * width + 1 for h in held])
    each = table.rows.withColumn(
        "piece", F.explode(F.array(*[F.lit(p) for p in range(len(pieces))]))
    )
    return each.select(
        "piece",
        "row",
        F.when(F.col("fold") == of_piece(held), F.col("id")).alias("id"),
        "label",
        "fold",
        "h",
        F.substring("codes", starts, F.lit(width)).alias("codes"),
    ).repartitionById(len(pieces), F.col("piece"))


@dataclass(frozen=True)
class Rows:
    """Codes, labels and hashes of a fit's training rows, and codes of the rows it scores."""

    codes: np.ndarray
    label: np.ndarray
    h: np.ndarray
    others: np.ndarray


def _grower(
    fits: Sequence[Fit], columns: Sequence[str], pieces: Sequence[tuple[int, int, int]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of the held rows of each piece that a partition has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        names = ("row", "id", "label", "fold")
        for batch in batches:
            codes = jb.matrix(batch.column("codes"), np.uint8, len(columns))
            piece, fold = batch.column("piece").to_numpy(), batch.column("fold").to_numpy()
            label, h = batch.column("label").to_numpy(), batch.column("h").to_numpy()
            for p in np.unique(piece):
                fit = fits[pieces[p][0]]
                seen = codes[:, [columns.index(c) for c in fit.columns]]
                known = np.flatnonzero((piece == p) & (fold != fit.held))
                asked = np.flatnonzero((piece == p) & (fold == fit.held))
                own = pa.table(batch.select(names).take(pa.array(asked)))
                parts.setdefault(int(p), []).append(
                    (seen[known], label[known], h[known], seen[asked], own)
                )
        for p in sorted(parts):
            codes, label, h, others, own = zip(*parts.pop(p), strict=True)
            k, first, last = pieces[p]
            fit = fits[k]
            rows = Rows(*(np.concatenate(x) for x in (codes, label, h, others)))
            if not len(rows.others):
                continue
            if isinstance(fit.ensemble, DeepForest):
                found = forest_sums(rows, fit.ensemble, fit.class_weights, first, last)
            else:
                found = boosted_scores(rows, fit.ensemble, fit.class_weights)
            table = pa.concat_tables(own).append_column("score", pa.array(found))
            table = table.add_column(0, "fit", pa.array(np.full(len(found), k, np.int32)))
            yield from table.combine_chunks().to_batches()

    return run


def forest_sums(
    rows: Rows, forest: DeepForest, class_weights: tuple[float, float], first: int, last: int
) -> np.ndarray:
    """Positive shares of the rows to be scored, summed over the trees from ``first`` to ``last``."""
    total = np.zeros(len(rows.others))
    positive = rows.label == 1
    for t in range(first, last):
        n = draws(rows.h, t)
        drawn = np.flatnonzero(n)
        share = grown_below(
            rows.codes[drawn],
            np.where(positive, 0, n)[drawn],
            np.where(positive, n, 0)[drawn],
            rows.others,
            class_weights,
            forest.depth,
            [forest.seed, t, 0],
            forest.min_leaf,
            forest.feature_share,
        )
        total += np.rint(share * 2.0**40)
    # Whole numbers, so that the order in which tasks are added up has no say.
    return total


# --- boosted trees ---------------------------------------------------------------------------


def _sums_of(
    columns: Sequence[np.ndarray], at: np.ndarray, node: np.ndarray, n_nodes: int,
    counted: np.ndarray, r: np.ndarray,
) -> np.ndarray:
    """``(2, node, feature, code)``: rows by class in one number, and weighted residuals."""
    out = np.empty((2, n_nodes, len(columns), CODES))
    base, counted, r = node * CODES, counted[at], r[at]
    for f, own in enumerate(columns):
        slot = base + own[at]
        for which, values in enumerate((counted, r)):
            out[which, :, f] = np.bincount(slot, values, n_nodes * CODES).reshape(-1, CODES)
    return out


def boosted_tree(
    columns: Sequence[np.ndarray], at: np.ndarray, r: np.ndarray, counted: np.ndarray,
    boosting: jb.Boosting, class_weights: tuple[float, float], number: int,
) -> tuple:
    """Tree ``number`` on the rows ``at``: that of :func:`joint_boosting.grown`. Of two siblings
    the one with fewer rows is summed, the other is their parent less that one."""
    tree = jb.Tree()
    n_features = len(columns)
    opened = [0]
    node = np.zeros(len(at), np.int64)
    sums = _sums_of(columns, at, node, 1, counted, r)
    for level in range(boosting.depth):
        packed = sums[0].astype(np.int64)
        positive = packed >> COUNT_BITS
        rows = np.stack([(packed & ((1 << COUNT_BITS) - 1)) - positive, positive], axis=-1)
        looked = jb.features_of_nodes(boosting, len(opened), n_features, [number, level])
        found = jb.best_cuts(rows, sums[1], class_weights, boosting.min_leaf, looked)
        if level == 0:
            tree.value[0] = float(found["value"][0])
        splits = np.flatnonzero(found["feature"] >= 0)
        if not len(splits):
            break
        enough = 2 * boosting.min_leaf
        # By open node and side: its place among the open nodes of the next level, or -1; and
        # among those whose rows are added up.
        place, summed = (np.full((len(opened), 2), -1) for _ in range(2))
        below, pairs, n_summed = [], [], 0
        for s in splits:
            n_left, n = int(found["n_left"][s]), int(found["n"][s])
            child = tree.split(
                opened[s], int(found["feature"][s]), int(found["cut"][s]),
                [float(found["left"][s]), float(found["right"][s])],
            )
            sizes = (n_left, n - n_left)
            own = [side for side in (0, 1) if sizes[side] >= enough]
            if not own:
                continue
            fewer = int(sizes[1] < sizes[0])
            summed[s, fewer] = n_summed
            for side in own:
                place[s, side] = len(below)
                below.append(child + side)
                pairs.append((s, n_summed, side == fewer))
            n_summed += 1
        tree.depth = level + 1
        if not below or level + 1 == boosting.depth:
            break
        feature, cut = found["feature"][node], found["cut"][node]
        side = np.zeros(len(at), np.int64)
        for f, own in enumerate(columns):
            mine = np.flatnonzero(feature == f)
            side[mine] = own[at[mine]] > cut[mine]
        new, added = place[node, side], summed[node, side]
        few = np.flatnonzero(added >= 0)
        part = _sums_of(columns, at[few], added[few], n_summed, counted, r)
        parent, which, is_part = (np.array(x) for x in zip(*pairs, strict=True))
        own_part = part[:, which]
        sums = np.where(is_part[None, :, None, None], own_part, sums[:, parent] - own_part)
        # A node that is too small to be split leaves its rows behind.
        left = np.flatnonzero(new >= 0)
        at, node, opened = at[left], new[left], below
    return tree.arrays()


def boosted_scores(
    rows: Rows, boosting: jb.Boosting, class_weights: tuple[float, float]
) -> np.ndarray:
    """Scores of the rows that the ensemble never saw."""
    columns = [c.astype(np.int64) for c in rows.codes.T]
    positive = rows.label == 1
    weight = np.where(positive, *class_weights[::-1])
    counted = 1.0 + positive * float(1 << COUNT_BITS)
    known, asked = np.zeros(len(rows.codes), np.float32), np.zeros(len(rows.others), np.float32)
    codes, others = np.ascontiguousarray(rows.codes), np.ascontiguousarray(rows.others)
    for number in range(boosting.trees):
        at = np.flatnonzero(uniforms(rows.h, number) < boosting.row_share)
        r = np.rint(jb.residuals(rows.label, known.astype(float), number) * weight * jb.SCALE)
        tree = boosted_tree(columns, at, r, counted, boosting, class_weights, number)
        rate = boosting.rate if number else 1.0
        known += rate * tree[3][jb.nodes_of(tree, codes)]
        asked += rate * tree[3][jb.nodes_of(tree, others)]
    return 1.0 / (1.0 + np.exp(-2.0 * asked.astype(float)))


# --- scores ----------------------------------------------------------------------------------


def held_scores(table: Coded, fits: Sequence[Fit], label: str, fold: str) -> DataFrame:
    """``(model, id, label, score, fold)`` of every fit's held rows."""
    pieces = []
    for k, fit in enumerate(fits):
        size = fit.ensemble.trees
        step = TREES_PER_TASK if isinstance(fit.ensemble, DeepForest) else size
        pieces += [(k, first, min(size, first + step)) for first in range(0, size, step)]
    kind = table.rows.schema["id"].dataType.simpleString()
    found = _dealt(table, fits, pieces).mapInArrow(
        _grower(fits, table.columns, pieces),
        f"fit int, row long, id {kind}, label int, fold int, score double",
    )
    if any(isinstance(fit.ensemble, DeepForest) for fit in fits):
        # A boosted ensemble is one piece, and so its row is the only one of its group.
        found = found.groupBy("fit", "row").agg(
            *[F.first(c).alias(c) for c in ("id", "label", "fold")], F.sum("score").alias("score")
        )
    names = F.array(*[F.lit(fit.name) for fit in fits])
    trees = [
        2.0**40 * fit.ensemble.trees if isinstance(fit.ensemble, DeepForest) else 1.0
        for fit in fits
    ]
    shares = F.array(*[F.lit(t) for t in trees])
    return found.select(
        F.element_at(names, F.col("fit") + 1).alias("model"),
        F.col("id").alias(table.id_column),
        F.col("label").alias(label),
        (F.col("score") / F.element_at(shares, F.col("fit") + 1)).alias("score"),
        F.col("fold").cast(table.fold_type).alias(fold),
    )
