"""Gradient-boosted trees of many fits, grown side by side.

A search fits the same rows many times, and each fit alone is a chain of small jobs: some for every
level of every tree. Here the trees of all fits grow together. A pass over the rows adds up, in the
tasks, what the next level of every fit's current tree needs to be split; the driver holds the splits
of the current trees. Between two trees the rows get their new margins, of all fits, and are kept.
Values are coded by the quantiles of each fit's own training rows.

Loss, weights and leaves are those of MLlib's ``GBTClassifier``: labels are -1 and 1, a tree is fitted
to ``4 y / (1 + exp(2 y F))``, the first one counts whole and the others by the learning rate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.operators.deep_forest import CODES, bin_edges, uniforms
from secondcart.sources.writers import materialize

# Rows of a partition that are kept and passed over together.
PARTITION_ROWS = 200_000
# Nodes whose sums are added up in one group.
NODES_PER_GROUP = 32
# Weighted residuals are summed as whole numbers of this many to one, so that their order has no say.
SCALE = float(1 << 20)
# Sums of this many node and feature pairs, of all fits, are held by a task at a time.
PASS_CELLS = 40_000


@dataclass(frozen=True)
class Boosting:
    """Size of an ensemble and of its trees, and what a tree and a node get to see."""

    trees: int
    depth: int
    rate: float
    row_share: float
    feature_share: float
    min_leaf: int
    seed: int


@dataclass(frozen=True)
class Fit:
    """An ensemble that is fitted to all folds but the ``held`` one, whose rows it scores."""

    name: str
    columns: tuple[str, ...]
    boosting: Boosting
    held: int
    class_weights: tuple[float, float]


@dataclass
class Tree:
    """Nodes in lists. A leaf is its own child, by a cut that no code is above."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [CODES])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, cut: int, values: Sequence[float]) -> int:
        left = len(self.child)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, left
        self.feature += [0, 0]
        self.cut += [CODES, CODES]
        self.child += [left, left + 1]
        self.value += values
        return left

    def arrays(self) -> tuple:
        own = (np.array(self.feature), np.array(self.cut), np.array(self.child))
        return *own, np.array(self.value), self.depth


def nodes_of(tree: tuple, codes: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    feature, cut, child, _, depth = tree
    flat, first = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
    node = np.zeros(len(codes), np.int64)
    for _ in range(depth):
        node = child[node] + (flat[first + feature[node]] > cut[node])
    return node


def residuals(label: np.ndarray, margin: np.ndarray, number: int) -> np.ndarray:
    """What tree ``number`` is fitted to."""
    sign = np.where(label == 1, 1.0, -1.0)
    if number == 0:
        return sign
    return 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


# --- rows ------------------------------------------------------------------------------------


def _binary(values: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    values = np.ascontiguousarray(values)
    n, width = len(values), values.itemsize * values.shape[1]
    ends = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(values)])


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The matrix of :func:`_binary`."""
    _, ends, data = column.buffers()
    start = int(np.frombuffer(ends, np.int32)[column.offset])
    size = len(column) * width
    found = np.frombuffer(data, kind, size, start) if size else np.zeros(0, kind)
    return found.reshape(len(column), width)


def row_coder(
    edges: Sequence[dict[str, list[float]]], columns: Sequence[str], n_fits: int = 0
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes (edges below the value) by the edges of each held fold, and margins of 0 if there are
    fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(edges), len(columns)), np.uint8)
            for f, name in enumerate(columns):
                values = batch.column(f"x{f}").to_numpy(zero_copy_only=False).astype(float)
                if np.isnan(values).any():
                    raise ValueError(f"{name} has no value")
                for k, own in enumerate(edges):
                    codes[:, k, f] = np.searchsorted(own[name], values, side="left")
            own = [
                *[batch.column(c) for c in ("id", "label", "fold", "h")],
                _binary(codes.reshape(batch.num_rows, -1)),
            ]
            if n_fits:
                own.append(_binary(np.zeros((batch.num_rows, n_fits), np.float32)))
            yield pa.RecordBatch.from_arrays(own, names=list(ROW[: len(own)]))

    return run


@dataclass(frozen=True)
class Layout:
    """Where the codes and margins of a fit are."""

    fits: tuple[Fit, ...]
    held: tuple[int, ...]
    columns: tuple[str, ...]

    def margins(self, batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch.column("margins"), np.float32, len(self.fits))

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        width = len(self.held) * len(self.columns)
        flat = matrix(batch.column("codes"), np.uint8, width)
        return flat.reshape(len(flat), len(self.held), len(self.columns))

    def own(self, codes: np.ndarray, k: int) -> np.ndarray:
        """The codes that a fit sees, of its own columns."""
        fit = self.fits[k]
        at = [self.columns.index(c) for c in fit.columns]
        return np.ascontiguousarray(codes[:, self.held.index(fit.held)][:, at])


# --- levels ----------------------------------------------------------------------------------


def _level_sums(
    layout: Layout, trees: dict[int, tuple], opened: dict[int, list[int]], number: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by class, and weighted residuals, of every code in the open nodes: task sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, sums_of = {}, {}
        for batch in batches:
            codes, margins = layout.codes(batch), layout.margins(batch)
            label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            chance = uniforms(batch.column("h").to_numpy(), number)
            for k, own in opened.items():
                fit = layout.fits[k]
                at = np.flatnonzero((fold != fit.held) & (chance < fit.boosting.row_share))
                seen = layout.own(codes[at], k)
                place = np.full(len(trees[k][0]), -1)
                place[own] = np.arange(len(own))
                node = place[nodes_of(trees[k], seen)]
                inside = np.flatnonzero(node >= 0)
                at, seen, node = at[inside], seen[inside], node[inside]
                positive = label[at] == 1
                r = residuals(label[at], margins[at, k].astype(float), number)
                r = np.rint(r * np.where(positive, *fit.class_weights[::-1]) * SCALE)
                n_features = len(fit.columns)
                slot = (node[:, None] * n_features + np.arange(n_features)) * CODES + seen
                size = len(own) * n_features * CODES
                counted = np.bincount((2 * slot + positive[:, None]).ravel(), minlength=2 * size)
                summed = np.bincount(slot.ravel(), np.repeat(r, n_features), size)
                rows_of[k] = rows_of.get(k, 0) + counted
                sums_of[k] = sums_of.get(k, 0) + summed
        for k, counted in rows_of.items():
            n_open = len(opened[k])
            counted = counted.astype(np.int32).reshape(n_open, -1)
            summed = sums_of[k].astype(np.int64).reshape(n_open, -1)
            parts = range(0, n_open, NODES_PER_GROUP)
            cuts = [slice(a, a + NODES_PER_GROUP) for a in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cuts), k, np.int32)),
                    pa.array(np.arange(len(cuts), dtype=np.int32)),
                    pa.array([counted[c].tobytes() for c in cuts], pa.binary()),
                    pa.array([summed[c].tobytes() for c in cuts], pa.binary()),
                ],
                names=["fit", "part", "rows", "sums"],
            )

    return run


def best_cuts(
    rows: np.ndarray, sums: np.ndarray, class_weights: tuple[float, float], min_leaf: int,
    looked: np.ndarray,
) -> dict[str, np.ndarray]:
    """The split of each node that lowers the squared error most: feature -1 where none does.

    ``rows(node, feature, code, class)`` and ``sums(node, feature, code)`` are rows and weighted
    residuals; ``looked(node, feature)`` are the features that a node may be split by.
    """
    n0, n1 = rows[..., 0].cumsum(axis=2), rows[..., 1].cumsum(axis=2)
    n, r = n0 + n1, sums.cumsum(axis=2) / SCALE
    w = n0 * class_weights[0] + n1 * class_weights[1]
    all_n, all_r, all_w = n[..., -1:], r[..., -1:], w[..., -1:]
    fine = (n >= min_leaf) & (all_n - n >= min_leaf) & looked[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = r / w, (all_r - r) / (all_w - w)
        gain = r * left + (all_r - r) * right - all_r**2 / all_w
    gain = np.where(fine, gain, -1.0).reshape(len(rows), -1)
    where = gain.argmax(axis=1)
    at = np.arange(len(rows))
    feature, cut = np.divmod(where, rows.shape[2])
    splits = gain[at, where] > 1e-9 * all_w[:, 0, 0]
    return {
        "feature": np.where(splits, feature, -1).astype(np.int32),
        "cut": cut.astype(np.int32),
        "n_left": n[at, feature, cut],
        "n": all_n[:, 0, 0],
        "left": left[at, feature, cut],
        "right": right[at, feature, cut],
        "value": (all_r / np.maximum(all_w, 1e-300))[:, 0, 0],
    }


def features_of_nodes(boosting: Boosting, n_nodes: int, n_features: int, key: Sequence[int]):
    """The features that each node looks at: a random share of them, as a mask."""
    wanted = max(1, math.ceil(boosting.feature_share * n_features))
    order = np.random.default_rng([boosting.seed, *key]).random((n_nodes, n_features))
    return order.argsort(axis=1).argsort(axis=1) < wanted


def _level_splits(
    layout: Layout, n_open: dict[int, int], number: int, level: int
) -> Callable[[pa.Table], pa.Table]:
    """The best split of each open node of a group, from the sums of all tasks."""

    def run(group: pa.Table) -> pa.Table:
        k, part = group["fit"][0].as_py(), group["part"][0].as_py()
        fit = layout.fits[k]
        rows = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in group["rows"].to_pylist())
        sums = sum(np.frombuffer(b, np.int64) for b in group["sums"].to_pylist())
        n_features = len(fit.columns)
        rows, sums = rows.reshape(-1, n_features, CODES, 2), sums.reshape(-1, n_features, CODES)
        first = part * NODES_PER_GROUP
        looked = features_of_nodes(fit.boosting, n_open[k], n_features, [number, level])
        found = best_cuts(
            rows, sums, fit.class_weights, fit.boosting.min_leaf, looked[first : first + len(rows)]
        )
        return pa.table(
            {
                "fit": pa.array(np.full(len(rows), k, np.int32)),
                "place": pa.array(np.arange(first, first + len(rows), dtype=np.int32)),
                **{name: pa.array(values) for name, values in found.items()},
            }
        )

    return run


SPLITS = (
    "fit int, place int, feature int, cut int, n_left long, n long, left double, right double,"
    " value double"
)


def passes(opened: dict[int, list[int]], layout: Layout) -> Iterator[dict[int, list[int]]]:
    """Fits that share a pass: as many as a task can hold the sums of, or one."""
    now, cells = {}, 0
    for k, own in opened.items():
        size = len(own) * len(layout.fits[k].columns)
        if now and cells + size > PASS_CELLS:
            yield now
            now, cells = {}, 0
        now[k] = own
        cells += size
    if now:
        yield now


def grown(rows: DataFrame, layout: Layout, active: Sequence[int], number: int) -> dict[int, tuple]:
    """Tree ``number`` of the active fits."""
    trees = {k: Tree() for k in active}
    opened = {k: [0] for k in active}
    for level in range(max(layout.fits[k].boosting.depth for k in active)):
        below: dict[int, list[int]] = {}
        for together in passes(opened, layout):
            arrays = {k: trees[k].arrays() for k in together}
            sums = rows.mapInArrow(
                _level_sums(layout, arrays, together, number),
                "fit int, part int, rows binary, sums binary",
            )
            n_open = {k: len(own) for k, own in together.items()}
            found = sums.groupBy("fit", "part").applyInArrow(
                _level_splits(layout, n_open, number, level), SPLITS
            )
            for s in sorted(found.collect(), key=lambda s: (s["fit"], s["place"])):
                k = s["fit"]
                tree, node, size = trees[k], together[k][s["place"]], layout.fits[k].boosting
                if node == 0:
                    tree.value[0] = s["value"]
                if s["feature"] < 0:
                    continue
                child = tree.split(node, s["feature"], s["cut"], [s["left"], s["right"]])
                tree.depth = level + 1
                if level + 1 < size.depth:
                    # A node of fewer rows has no split that leaves enough on both sides.
                    enough = 2 * size.min_leaf
                    sides = (s["n_left"], s["n"] - s["n_left"])
                    own = [child + side for side in (0, 1) if sides[side] >= enough]
                    if own:
                        below.setdefault(k, []).extend(own)
        opened = below
        if not opened:
            break
    return {k: tree.arrays() for k, tree in trees.items()}


# --- margins and scores ----------------------------------------------------------------------


def _stepped(
    layout: Layout, trees: dict[int, tuple], number: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the margins that they have after the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, margins = layout.codes(batch), layout.margins(batch).copy()
            for k, tree in trees.items():
                rate = layout.fits[k].boosting.rate if number else 1.0
                margins[:, k] += rate * tree[3][nodes_of(tree, layout.own(codes, k))]
            columns = [_binary(margins) if n == "margins" else batch.column(n) for n in ROW]
            yield pa.RecordBatch.from_arrays(columns, names=list(ROW))

    return run


ROW = ("id", "label", "fold", "h", "codes", "margins")


def _scorer(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, margins = batch.column("fold").to_numpy(), layout.margins(batch)
            for k, fit in enumerate(layout.fits):
                at = np.flatnonzero(fold == fit.held)
                if not len(at):
                    continue
                own = batch.take(pa.array(at))
                score = 1.0 / (1.0 + np.exp(-2.0 * margins[at, k].astype(float)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fit.name] * len(at)),
                        own.column("id"),
                        own.column("label"),
                        pa.array(score),
                        own.column("fold"),
                    ],
                    names=["model", "id", "label", "score", "fold"],
                )

    return run


def held_scores(
    fits: Sequence[Fit], rows: DataFrame, id_column: str, label: str, fold: str
) -> DataFrame:
    """``(model, id, label, score, fold)`` of every fit's held rows, written."""
    held = tuple(sorted({f.held for f in fits}))
    columns = tuple(dict.fromkeys(c for f in fits for c in f.columns))
    layout = Layout(tuple(fits), held, columns)
    spark = rows.sparkSession
    inside = rows.where(F.col(fold).isNotNull())
    edges = [bin_edges(inside.where(F.col(fold) != k), columns) for k in held]
    plain = inside.select(
        F.col(id_column).alias("id"),
        F.col(label).cast("int").alias("label"),
        F.col(fold).cast("int").alias("fold"),
        F.xxhash64(F.lit(fits[0].boosting.seed), F.col(id_column)).alias("h"),
        *[F.col(c).cast("double").alias(f"x{f}") for f, c in enumerate(columns)],
    )
    parts = max(math.ceil(plain.count() / PARTITION_ROWS), spark.sparkContext.defaultParallelism)
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"id {kind}, label int, fold int, h long, codes binary, margins binary"
    state = plain.coalesce(parts).mapInArrow(row_coder(edges, columns, len(fits)), schema)
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for number in range(max(f.boosting.trees for f in fits)):
            active = [k for k, f in enumerate(fits) if number < f.boosting.trees]
            trees = grown(state, layout, active, number)
            after = state.mapInArrow(_stepped(layout, trees, number), schema)
            after = after.persist(StorageLevel.MEMORY_AND_DISK)
            after.count()
            state.unpersist()
            state = after
        scores = state.mapInArrow(
            _scorer(layout), f"model string, id {kind}, label int, score double, fold int"
        )
        own_fold = F.col("fold").cast(rows.schema[fold].dataType).alias(fold)
        return materialize(
            scores.select("model", F.col("id").alias(id_column), "label", "score", own_fold),
            "boosted-scores",
        )
    finally:
        state.unpersist()
