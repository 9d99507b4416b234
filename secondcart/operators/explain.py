"""Attribution of tree-ensemble predictions to features (path-dependent Shapley values).

A leaf contributes its value times one factor per feature on its path: 1 or 0 when the feature is
known (inside or outside the leaf's interval), and the share of training weight that went the
leaf's way when it is not. For such a product the Shapley value of feature i is

    value * (inside_i - share_i) * integral over t in [0, 1] of
        prod over j != i of (inside_j * t + share_j * (1 - t))

The integrand is a polynomial in t, so a short Gauss-Legendre rule is exact, and all leaves with
the same number of features are evaluated together. The model (small, already on the driver) goes
to the executors once; rows are scored where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.functions.lookups import TREE_FEATURES, UNSIGNED_FEATURES, lookup
from secondcart.operators.metrics import spearman
from secondcart.sources.writers import shared_folder

# A model with more conditions than this is too large to send to every executor.
MAX_CONDITIONS = 20_000_000
MAX_NODES = 5_000_000
CELLS_PER_CHUNK = 4_000_000

LeafTable = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def tree_nodes(model, spark) -> DataFrame:
    """The nodes of a saved tree ensemble as a table."""
    path = f"{shared_folder(spark)}/secondcart/models/{uuid.uuid4().hex}"
    model.save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def leaf_table(model: RandomForestClassificationModel | GBTClassificationModel, spark) -> LeafTable:
    """Leaves grouped by the number of features on their path.

    Per group: feature index, lower and upper bound (low < x <= high), share, and leaf value. The
    value is in probability for a forest and in log-odds for boosting.
    """
    is_forest = isinstance(model, RandomForestClassificationModel)
    weights = model.treeWeights
    trees: dict[int, dict[int, object]] = {}
    nodes = tree_nodes(model, spark)
    n_nodes = nodes.count()
    if n_nodes > MAX_NODES:
        raise ValueError(f"{n_nodes} tree nodes: the model is too large to send to executors")
    for row in nodes.collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row

    leaves: dict[int, list] = {}
    conditions = 0
    for tree, nodes in trees.items():
        stack = [(0, {})]
        while stack:
            node_id, path = stack.pop()
            node = nodes[node_id]
            stats = node["impurityStats"]
            if node["leftChild"] < 0:
                if is_forest:
                    value = stats[1] / sum(stats) / len(weights)
                else:
                    value = 2.0 * weights[tree] * node["prediction"]
                conditions += len(path)
                leaves.setdefault(len(path), []).append((path, value))
                continue
            split = node["split"]
            feature, threshold = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            cover = sum(stats) if is_forest else stats[0]
            for child, bounds in (
                (node["leftChild"], (low, min(high, threshold))),
                (node["rightChild"], (max(low, threshold), high)),
            ):
                child_stats = nodes[child]["impurityStats"]
                child_cover = sum(child_stats) if is_forest else child_stats[0]
                stack.append(
                    (child, {**path, feature: (*bounds, share * child_cover / cover)})
                )
    if conditions > MAX_CONDITIONS:
        raise ValueError(f"{conditions} leaf conditions: the model is too large to broadcast")
    table: LeafTable = {}
    for depth, group in leaves.items():
        features = np.array([list(p) for p, _ in group], dtype=np.int32).reshape(-1, depth)
        bounds = np.array([list(p.values()) for p, _ in group], dtype=float).reshape(-1, depth, 3)
        values = np.array([v for _, v in group])
        table[depth] = (features, bounds[:, :, 0], bounds[:, :, 1], bounds[:, :, 2], values)
    return table


def expected_value(table: LeafTable) -> float:
    """Prediction when no feature is known."""
    return float(sum((v * share.prod(axis=1)).sum() for _, _, _, share, v in table.values()))


def attributions(table: LeafTable, x: np.ndarray) -> np.ndarray:
    """Attribution of every feature for each row of ``x``."""
    phi = np.zeros(x.shape)
    for depth, (features, low, high, share, value) in table.items():
        if depth == 0:
            continue
        nodes, node_weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
        nodes, node_weights = (nodes + 1) / 2, node_weights / 2
        rows = max(1, CELLS_PER_CHUNK // features.size)
        for start in range(0, len(x), rows):
            chunk = x[start : start + rows]
            cells = chunk[:, features]
            inside = ((cells > low) & (cells <= high)).astype(float)
            integral = np.zeros(inside.shape)
            for t, w in zip(nodes, node_weights, strict=True):
                factors = inside * t + share * (1 - t)  # never 0, as 0 < t < 1 and share > 0
                integral += w * factors.prod(axis=2, keepdims=True) / factors
            parts = value[None, :, None] * (inside - share) * integral
            for j in range(x.shape[1]):
                phi[start : start + rows, j] += np.where(features == j, parts, 0.0).sum(axis=(1, 2))
    return phi


def tree_shap(
    model: PipelineModel, rows: DataFrame, columns: Sequence[str], id_column: str
) -> DataFrame:
    """Long table ``(id, feature, value, phi)`` for the rows of ``rows``."""
    spark = rows.sparkSession
    table = spark.sparkContext.broadcast(leaf_table(model.stages[-1], spark))
    names = list(columns)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            yield pd.DataFrame(
                {
                    id_column: batch[id_column],
                    "x": list(x),
                    "phi": list(attributions(table.value, x)),
                }
            )

    id_type = rows.schema[id_column].dataType.simpleString()
    wide = rows.select(id_column, *names).mapInPandas(
        explain, f"{id_column} {id_type}, x array<double>, phi array<double>"
    )
    named = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x"), F.col("phi")
    )
    return wide.select(id_column, F.explode(named).alias("cell")).select(
        id_column,
        F.col("cell.feature").alias("feature"),
        F.col("cell.x").alias("value"),
        F.col("cell.phi").alias("phi"),
    )


def attribution_unit(model: PipelineModel) -> str:
    is_forest = isinstance(model.stages[-1], RandomForestClassificationModel)
    return "probability" if is_forest else "log-odds"


def shap_importance(shap: DataFrame, unit: str) -> DataFrame:
    """Mean absolute attribution per feature in ``unit``, with the rank correlation between the
    value and its attribution where that has a meaning."""
    importance = shap.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    signs = spearman(shap, "value", "phi", ["feature"])
    unsigned = F.col("feature").isin(UNSIGNED_FEATURES)
    return (
        importance.join(signs, "feature", "left")
        .select(
            "feature",
            "mean_abs_shap",
            F.lit(unit).alias("unit"),
            F.when(~unsigned, F.col("spearman")).alias("value_shap_correlation"),
            lookup(F.col("feature"), TREE_FEATURES).alias("readable_name"),
        )
        .orderBy(F.desc("mean_abs_shap"))
    )
