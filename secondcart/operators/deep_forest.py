"""Random forests whose trees are grown until their leaves are pure, without a tree on the driver.

A tree without a depth limit has about as many nodes as rows, so its lower part is never brought
together. Nodes of many rows are split level by level, all trees in one pass, by counts that are
added up in the tasks. Rows are then dealt by tree and node, and a task grows the rest of a node's
tree and scores the test rows that fell into it. The driver holds the nodes of many rows only;
scores are averaged by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.operators.caching import persisted

# Intervals per feature, as many as MLlib's trees tell apart.
BINS = 32
CODES = BINS + 1
CODE_BITS = 6
CODES_PER_LONG = 10
QUANTILE_ACCURACY = 10_000
# Draws of a node up to which a task grows the rest of its tree.
NODE_DRAWS = 16_384
# Nodes of a tree whose counts are added up in one group.
NODES_PER_GROUP = 32
# Nodes whose counts a task holds at a time.
NODES_AT_ONCE = 4096
# How often a tree draws a row is Poisson of mean 1; more than 12 times is as good as impossible.
DRAWS_BELOW = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class DeepForest:
    """Size of a forest on balanced classes. Each node looks at a random share of the features, or
    at as many as the root of their number, and leaves have ``min_leaf`` draws or more."""

    trees: int
    depth: int
    seed: int
    min_leaf: int = 1
    feature_share: float | None = None


def bin_edges(rows: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """At most 31 ascending edges per column: its quantiles, or all values but the last where there
    are no more than 32."""
    shares = [k / BINS for k in range(1, BINS)]
    guess = rows.agg(
        *[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns],
        *[
            F.percentile_approx(F.col(c).cast("double"), shares, QUANTILE_ACCURACY).alias(f"q_{c}")
            for c in columns
        ],
    ).first()
    few = [c for c in columns if guess[f"n_{c}"] <= 2 * BINS]
    levels = rows.agg(
        F.lit(0), *[F.collect_set(F.col(c).cast("double")).alias(c) for c in few]
    ).first()
    exact = {c: sorted(levels[c])[:-1] for c in few if len(levels[c]) <= BINS}
    return {c: exact.get(c, sorted(set(guess[f"q_{c}"] or []))) for c in columns}


def _code(column: str, edges: Sequence[float]) -> Column:
    """Number of edges below the value."""
    x = F.col(column).cast("double")
    code = F.lit(0)
    for edge in edges:
        code = code + (x > F.lit(edge)).cast("int")
    return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"{column} has no value"))).otherwise(
        code
    )


def _packed(columns: Sequence[str]) -> Column:
    """Codes as an array of longs, ten to each."""
    longs = []
    for start in range(0, len(columns), CODES_PER_LONG):
        part = F.lit(0).cast("long")
        for k, c in enumerate(columns[start : start + CODES_PER_LONG]):
            part = part + F.shiftleft(F.col(c).cast("long"), CODE_BITS * k)
        longs.append(part)
    return F.array(*longs)


def unpacked(longs: np.ndarray, features: int) -> np.ndarray:
    """The codes of :func:`_packed`, a row each."""
    at = np.arange(features)
    shifted = longs[:, at // CODES_PER_LONG] >> (CODE_BITS * (at % CODES_PER_LONG))
    return (shifted & ((1 << CODE_BITS) - 1)).astype(np.int64)


def uniforms(hashes: np.ndarray, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each row and tree, from a hash of the row's key."""
    x = hashes.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def draws(hashes: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree draws each row."""
    return np.searchsorted(DRAWS_BELOW, uniforms(hashes, tree), side="right")


# --- splits ----------------------------------------------------------------------------------


def looked_at(
    n_nodes: int, features: int, key: Sequence[int], share: float | None = None
) -> np.ndarray:
    """The features that each node looks at: a random share of them, or ``sqrt(features)``."""
    order = np.random.default_rng(list(key)).random((n_nodes, features)).argsort(axis=1)
    wanted = math.sqrt(features) if share is None else share * features
    return order[:, : max(1, math.ceil(wanted))]


def best_splits(
    looked: np.ndarray, counts: Iterable[tuple[np.ndarray, np.ndarray]], n0: np.ndarray,
    n1: np.ndarray, class_weights: tuple[float, float], min_leaf: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Feature and code of the split that lowers the weighted Gini impurity most, for many nodes;
    feature -1 where none does with ``min_leaf`` draws on both sides. ``counts`` has negative and positive draws by node and code for one
    feature of each node after the other."""
    low, high = class_weights
    w0, w1 = n0 * low, n1 * high
    total = w0 + w1
    impurity = total - (w0 * w0 + w1 * w1) / total
    best = 1e-9 * total
    chosen, cut = np.full(len(total), -1), np.zeros(len(total), np.int64)
    for own, (c0, c1) in zip(looked.T, counts, strict=True):
        d0, d1 = c0.cumsum(axis=1), c1.cumsum(axis=1)
        left_n = d0 + d1
        some = (left_n >= min_leaf) & ((n0 + n1)[:, None] - left_n >= min_leaf)
        left0, left1 = d0 * low, d1 * high
        right0, right1 = (n0[:, None] - d0) * low, (n1[:, None] - d1) * high
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = (left0**2 + left1**2) / (left0 + left1)
            pure += (right0**2 + right1**2) / (right0 + right1)
        gain = np.where(some, impurity[:, None] - total[:, None] + pure, -1.0)
        where = gain.argmax(axis=1)
        most = gain[np.arange(len(total)), where]
        better = most > best
        best[better], chosen[better], cut[better] = most[better], own[better], where[better]
    return chosen, cut


def node_splits(
    codes: np.ndarray, at: np.ndarray, node: np.ndarray, negative: np.ndarray,
    positive: np.ndarray, looked: np.ndarray, n0: np.ndarray, n1: np.ndarray,
    class_weights: tuple[float, float], min_leaf: int,
) -> tuple[np.ndarray, np.ndarray]:
    """:func:`best_splits` of the nodes that hold the rows ``at``, a bounded number at a time; nodes
    of one class, or of too few draws, have none."""
    chosen, cut = np.full(len(n0), -1), np.zeros(len(n0), np.int64)
    mixed = np.flatnonzero((n0 > 0) & (n1 > 0) & (n0 + n1 >= 2 * min_leaf))
    place = np.full(len(n0), -1)
    place[mixed] = np.arange(len(mixed))
    place = place[node]
    inside = np.flatnonzero(place >= 0)
    firsts = range(0, len(mixed), NODES_AT_ONCE)
    if len(firsts) > 1:
        inside = inside[np.argsort(place[inside], kind="stable")]
    borders = [*np.searchsorted(place[inside], firsts[1:]), len(inside)] if firsts else []
    start = 0
    for first, end in zip(firsts, borders, strict=True):
        nodes, rows = mixed[first : first + NODES_AT_ONCE], inside[start:end]
        mine, own_at = place[rows] - first, at[rows]
        draws_of, size = (negative[own_at], positive[own_at]), len(nodes) * CODES

        def counted(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            slot = mine * CODES + codes[own_at, own[mine]]
            return tuple(np.bincount(slot, n, size).reshape(-1, CODES) for n in draws_of)

        own_looked = looked[nodes]
        chosen[nodes], cut[nodes] = best_splits(
            own_looked, map(counted, own_looked.T), n0[nodes], n1[nodes], class_weights, min_leaf
        )
        start = end
    return chosen, cut


def grown_below(
    codes: np.ndarray, negative: np.ndarray, positive: np.ndarray, others: np.ndarray,
    class_weights: tuple[float, float], depth: int, key: Sequence[int], min_leaf: int = 1,
    feature_share: float | None = None,
) -> np.ndarray:
    """Positive share of the leaf of each row of ``others``, in a tree grown on ``codes``.

    ``negative`` and ``positive`` are each row's draws by class. All nodes of a level are split
    together; ``key`` seeds the features that a node looks at.
    """
    out = np.zeros(len(others))
    node, other_node = np.zeros(len(codes), np.int64), np.zeros(len(others), np.int64)
    at, other_at = np.arange(len(codes)), np.arange(len(others))
    n_nodes = 1
    for level in range(depth + 1):
        n0 = np.bincount(node, negative[at], n_nodes)
        n1 = np.bincount(node, positive[at], n_nodes)
        if level < depth:
            looked = looked_at(n_nodes, codes.shape[1], [*key, level], feature_share)
            chosen, cut = node_splits(
                codes, at, node, negative, positive, looked, n0, n1, class_weights, min_leaf
            )
        else:
            chosen, cut = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64)
        is_leaf = (chosen < 0)[other_node]
        out[other_at[is_leaf]] = positive_share(n0, n1, class_weights)[other_node[is_leaf]]
        other_at, other_node = other_at[~is_leaf], other_node[~is_leaf]
        if not len(other_at):
            break
        # Nodes that no other row is in need not be grown.
        going = (chosen[node] >= 0) & np.isin(node, other_node)
        at, node = at[going], node[going]
        side = codes[at, chosen[node]] > cut[node]
        other_side = others[other_at, chosen[other_node]] > cut[other_node]
        # Nodes are numbered along their paths, so that the order of rows has no say.
        used, node = np.unique(2 * node + side, return_inverse=True)
        other_node = np.searchsorted(used, 2 * other_node + other_side)
        n_nodes = len(used)
    return out


def positive_share(
    n0: np.ndarray, n1: np.ndarray, class_weights: tuple[float, float]
) -> np.ndarray:
    return n1 * class_weights[1] / (n0 * class_weights[0] + n1 * class_weights[1])


# --- nodes of many rows ----------------------------------------------------------------------


@dataclass
class Top:
    """Nodes of many rows of one tree, and their children. A node with a feature has its children
    at ``child`` and the place after; one without is a leaf if it has a share, or else the rest of
    the tree below it is grown in a task."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])
    share: list[float] = field(default_factory=lambda: [math.nan])
    level: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.child[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.child.append(0)
            self.share.append(math.nan)
            self.level.append(self.level[node] + 1)
        return self.child[node]

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        feature, cut, child = (np.array(x) for x in (self.feature, self.cut, self.child))
        node = np.zeros(len(codes), np.int64)
        for _ in range(max(self.level)):
            at = np.flatnonzero(feature[node] >= 0)
            side = codes[at, feature[node[at]]] > cut[node[at]]
            node[at] = child[node[at]] + side
        return node


def _known(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    longs = batch.column("packed").flatten().to_numpy()
    codes = unpacked(longs.reshape(batch.num_rows, -1), features)
    return codes, batch.column("label").to_numpy(), batch.column("h").to_numpy()


def _level_counts(
    tops: Sequence[Top], opened: Sequence[Sequence[int]], features: int, key: Sequence[int],
    share: float | None,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Draws by class and code of the features that open nodes look at, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for batch in batches:
            codes, label, h = _known(batch, features)
            for t, (top, own) in enumerate(zip(tops, opened, strict=True)):
                if not own:
                    continue
                place = np.full(len(top.feature), -1)
                place[list(own)] = np.arange(len(own))
                node = place[top.nodes_of(codes)]
                n = draws(h, t)
                at = np.flatnonzero((node >= 0) & (n > 0))
                looked = looked_at(len(own), features, [*key, t], share)
                slots = np.arange(looked.shape[1])
                code = codes[at[:, None], looked[node[at]]]
                index = (node[at][:, None] * len(slots) + slots) * CODES + code
                index = 2 * index + (label[at] == 1)[:, None]
                size = looked.size * CODES * 2
                found = np.bincount(index.ravel(), np.repeat(n[at], len(slots)), size)
                counts[t] = counts.get(t, 0) + found.astype(np.int64)
        for t, found in counts.items():
            of_node = found.reshape(len(opened[t]), -1)
            places = np.flatnonzero(of_node.any(axis=1))
            width = of_node.shape[1]
            ends = pa.array(np.arange(len(places) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(places), t, np.int32)),
                    pa.array(places.astype(np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(of_node[places].ravel())),
                ],
                names=["tree", "place", "counts"],
            )

    return run


def _level_splits(
    opened: Sequence[Sequence[int]], features: int, class_weights: tuple[float, float],
    key: Sequence[int], min_leaf: int, share: float | None,
) -> Callable[[pa.Table], pa.Table]:
    """The best split of each open node of a group, from the counts of all tasks."""

    def run(group: pa.Table) -> pa.Table:
        t = group["tree"][0].as_py()
        looked = looked_at(len(opened[t]), features, [*key, t], share)
        places, own = np.unique(group["place"].to_numpy(), return_inverse=True)
        flat = group["counts"].combine_chunks().flatten().to_numpy()
        counts = np.zeros((len(places), flat.size // len(own)), np.int64)
        np.add.at(counts, own, flat.reshape(len(own), -1))
        counts = counts.reshape(len(places), looked.shape[1], CODES, 2)
        n0, n1 = counts[:, 0, :, 0].sum(axis=1), counts[:, 0, :, 1].sum(axis=1)
        by_slot = [(counts[:, k, :, 0], counts[:, k, :, 1]) for k in range(looked.shape[1])]
        chosen, cut = best_splits(
            looked[places], by_slot, n0, n1, class_weights, min_leaf
        )
        slot = (looked[places] == chosen[:, None]).argmax(axis=1)
        mine = counts[np.arange(len(places)), slot].sum(axis=2).cumsum(axis=1)
        return pa.table(
            {
                "tree": pa.array(np.full(len(places), t, np.int32)),
                "place": pa.array(places.astype(np.int32)),
                "feature": pa.array(chosen.astype(np.int32)),
                "cut": pa.array(cut.astype(np.int32)),
                "n_left": pa.array(mine[np.arange(len(places)), cut]),
                "n": pa.array(n0 + n1),
                "share": pa.array(positive_share(n0, n1, class_weights)),
            }
        )

    return run


def grown_tops(
    known: DataFrame, forest: DeepForest, features: int, rows: int,
    class_weights: tuple[float, float], node_draws: int = NODE_DRAWS,
) -> list[Top]:
    """The nodes of more than ``node_draws`` draws of all trees: one pass a level."""
    tops = [Top() for _ in range(forest.trees)]
    opened = [[0] if rows > node_draws else [] for _ in tops]
    for level in range(forest.depth):
        if not any(opened):
            break
        key = [forest.seed, level]
        counts = known.mapInArrow(
            _level_counts(tops, opened, features, key, forest.feature_share),
            "tree int, place int, counts array<long>",
        )
        found = (
            counts.withColumn("part", F.expr(f"place div {NODES_PER_GROUP}"))
            .groupBy("tree", "part")
            .applyInArrow(
                _level_splits(
                    opened, features, class_weights, key, forest.min_leaf, forest.feature_share
                ),
                "tree int, place int, feature int, cut int, n_left long, n long, share double",
            )
            .collect()
        )
        below = [[] for _ in tops]
        for r in sorted(found, key=lambda r: (r["tree"], r["place"])):
            top, node = tops[r["tree"]], opened[r["tree"]][r["place"]]
            if r["feature"] < 0:
                top.share[node] = r["share"]
                continue
            child = top.split(node, r["feature"], r["cut"])
            sizes = (r["n_left"], r["n"] - r["n_left"])
            below[r["tree"]] += [child + k for k in (0, 1) if sizes[k] > node_draws]
        opened = below
    return tops


# --- scores ----------------------------------------------------------------------------------


def _dealt(
    tops: Sequence[Top], features: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each tree and row: the node to be grown, or the share of a leaf that is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, h = _known(batch, features)
            is_test = batch.column("is_test").to_numpy(zero_copy_only=False)
            for t, top in enumerate(tops):
                node = top.nodes_of(codes)
                share = np.array(top.share)[node]
                n = np.where(is_test, 0, draws(h, t))
                at = np.flatnonzero(is_test | ((n > 0) & np.isnan(share)))
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), t, np.int32)),
                        pa.array(node[at].astype(np.int32)),
                        part.column("id"),
                        part.column("label"),
                        part.column("packed"),
                        pa.array(n[at].astype(np.int32)),
                        part.column("is_test"),
                        pa.array(share[at], from_pandas=True),
                    ],
                    names=["tree", "node", "id", "label", "packed", "draws", "is_test", "share"],
                )

    return run


def _scorer(
    levels: Sequence[Sequence[int]], features: int, class_weights: tuple[float, float],
    forest: DeepForest,
) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        longs = group["packed"].combine_chunks().flatten().to_numpy()
        codes = unpacked(longs.reshape(group.num_rows, -1), features)
        label, n = group["label"].to_numpy(), group["draws"].to_numpy()
        is_test = group["is_test"].to_numpy()
        known = ~is_test
        t, node = group["tree"][0].as_py(), group["node"][0].as_py()
        shares = grown_below(
            codes[known],
            np.where(label == 1, 0, n)[known],
            np.where(label == 1, n, 0)[known],
            codes[is_test],
            class_weights,
            forest.depth - levels[t][node],
            [forest.seed, t, node],
            forest.min_leaf,
            forest.feature_share,
        )
        tests = group.filter(pa.array(is_test))
        own = {name: tests[name] for name in ("id", "label", "packed")}
        return pa.table({**own, "share": pa.array(shares)})

    return run


def test_scores(
    forest: DeepForest, train: DataFrame, test: DataFrame, columns: Sequence[str], id_column: str,
    label: str, rows: int, class_weights: tuple[float, float], node_draws: int = NODE_DRAWS,
) -> DataFrame:
    """``(id, label, score)`` of the test rows: the mean over the trees of the positive share of
    the weight in their leaf. ``rows`` is the number of training rows."""
    edges = bin_edges(train, columns)
    names = [f"f{k}" for k in range(len(columns))]
    coded = [_code(c, edges[c]).alias(name) for c, name in zip(columns, names, strict=True)]
    own = [
        F.col(id_column).alias("id"),
        F.col(label).cast("int").alias("label"),
        F.xxhash64(F.lit(forest.seed), F.col(id_column)).alias("h"),
    ]
    both = train.select(*own, F.lit(False).alias("is_test"), *coded).unionAll(
        test.select(*own, F.lit(True).alias("is_test"), *coded)
    )
    packed = both.select("id", "label", "h", "is_test", _packed(names).alias("packed"))
    features = len(columns)
    with persisted(packed) as seen:
        tops = grown_tops(
            seen.where("not is_test"), forest, features, rows, class_weights, node_draws
        )
    kind = packed.schema["id"].dataType.simpleString()
    dealt = packed.mapInArrow(
        _dealt(tops, features),
        f"tree int, node int, id {kind}, label int, packed array<long>, draws int,"
        " is_test boolean, share double",
    )
    grown = dealt.where("share is null").groupBy("tree", "node").applyInArrow(
        _scorer([top.level for top in tops], features, class_weights, forest),
        f"id {kind}, label int, packed array<long>, share double",
    )
    if any(not math.isnan(share) for top in tops for share in top.share):
        grown = grown.unionAll(dealt.where("share is not null").select(*grown.columns))
    # Shares are summed as decimals, so that their order has no say. Rows with equal ids and codes
    # have the same score, and come out as often as they came in.
    total = F.sum(F.col("share").cast("decimal(30,15)")).cast("double")
    scores = grown.groupBy(F.col("id").alias(id_column), "label", "packed").agg(
        (total / F.count("*")).alias("score"),
        F.expr(f"count(*) div {forest.trees}").cast("int").alias("copies"),
    )
    copy = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return scores.select(id_column, "label", "score", copy.alias("copy")).drop("copy")
