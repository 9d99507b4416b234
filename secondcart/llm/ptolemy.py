"""Centroid clustering in integers, with distances ruled out by Ptolemy's inequality.

For points v, c and pivots p, q of a Euclidean space ``|vp * cq - vq * cp| <= vc * pq``. The
distances of all vectors to a few pivots never change, so they are computed once and written; a
round then needs the pivot distances of its centroids only to know which centroids cannot be the
nearest of a vector. What is left is measured exactly, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from secondcart.llm.common import exact_columns
from secondcart.sources.writers import materialize

DIMENSION = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
PIVOTS = 6
# Scaled components up to this size have squared distances that fit 64 bits.
LARGEST = 1 << 27
# Rows that are measured at a time.
BLOCK = 8192
# Relative error allowed for in every rounded bound; double arithmetic here stays below 2**-48.
SLACK = 2.0**-40

POINTS = "vec_id long, point array<int>, to_pivots array<double>"
ASSIGNED = "vec_id long, cluster int, distance long"


def hashed(tag: str, id_column: str) -> Column:
    """Lowercase hex SHA-256 of ``tag:id``; a missing id counts as an empty one."""
    text = F.concat_ws(":", F.lit(tag), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.sha2(text.cast("binary"), 256)


def kept_points(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``vec_id, point`` of the vectors with ``dimension`` finite components, in scaled integers.

    NULL vectors, other lengths, and vectors with a NULL, NaN or infinite component are left out.
    """
    rows = exact_columns(vectors, "vec_id", "embedding")
    if not isinstance(rows.schema["embedding"].dataType, ArrayType):
        rows = rows.withColumn("embedding", F.lit(None).cast("array<double>"))

    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)

    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.where(
        (F.size("embedding") == dimension) & F.forall("embedding", finite)
    ).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("point"))


def first_points(points: DataFrame, tag: str, count: int) -> list[list[int]]:
    """``count`` points with the smallest hashes of their ids; equal hashes go by the points."""
    order = [hashed(tag, "vec_id"), F.col("point")]
    return [list(r["point"]) for r in points.orderBy(*order).limit(count).collect()]


def pivots_of(points: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` different points, drawn by another hash of their ids."""
    different: list[list[int]] = []
    for p in first_points(points, "pivot", 16 * count):
        if p not in different:
            different.append(p)
    dimension = len(different[0]) if different else 0
    return np.array(different[:count], np.int64).reshape(-1, dimension)


def exact_distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(points), len(pivots)))
    for k, pivot in enumerate(pivots):
        out[:, k] = np.sqrt(exact_distances(points, pivot).astype(np.float64))
    return out


class Bounds:
    """Lower bounds of the distances from vectors to some centres, by way of pivot pairs."""

    def __init__(self, centres: np.ndarray, pivots: np.ndarray):
        self.centres = centres
        self.of_centres = to_pivots(centres, pivots)
        apart = to_pivots(pivots, pivots)
        self.pairs = [
            (p, q, apart[p, q]) for p in range(len(pivots)) for q in range(p) if apart[p, q] > 0
        ]

    def squared(self, cached: np.ndarray) -> np.ndarray:
        """For every vector and centre a number that their squared distance does not fall below.

        The difference of two rounded products is off by a share of the products, not of itself,
        so that share is taken off before anything else.
        """
        out = np.zeros((len(cached), len(self.centres)))
        for p, q, apart in self.pairs:
            one = cached[:, p, None] * self.of_centres[None, :, q]
            other = cached[:, q, None] * self.of_centres[None, :, p]
            low = (np.abs(one - other) - (one + other) * SLACK) / apart
            np.maximum(out, low, out=out)
        return out * out * (1 - SLACK)

    def nearest(self, points: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centre (the smaller number of equally near ones), squared distance, and how
        many distances had to be measured."""
        bounds = self.squared(cached)
        first = np.argmin(bounds, axis=1)
        best = exact_distances(points, self.centres[first])
        cluster, measured = first.copy(), len(points)
        for k in range(len(self.centres)):
            # A bound equal to the best distance may still be a tie, which the number decides.
            at = np.flatnonzero((bounds[:, k] <= best) & (first != k))
            if not len(at):
                continue
            distance = exact_distances(points[at], self.centres[k])
            better = (distance < best[at]) | ((distance == best[at]) & (k < cluster[at]))
            best[at[better]], cluster[at[better]] = distance[better], k
            measured += len(at)
        return cluster, best, measured


def _blocks(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            n = part.num_rows
            points, cached = (part.column(c).flatten().to_numpy() for c in ("point", "to_pivots"))
            yield part.column("vec_id"), points.reshape(n, -1).astype(np.int64), cached.reshape(n, -1)


def with_pivots(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Points with their distances to the pivots, which all rounds read."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                flat = part.column("point").flatten().to_numpy()
                cached = to_pivots(flat.reshape(part.num_rows, -1).astype(np.int64), pivots)
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * len(pivots)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cached.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("point"), lists],
                    names=["vec_id", "point", "to_pivots"],
                )

    ints = points.select("vec_id", F.col("point").cast("array<int>").alias("point"))
    return ints.mapInArrow(run, POINTS)


def moved(cached: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centres after one round: the floored means of their vectors.

    Every task adds its own vectors up, so that one row per task and centre is shuffled.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(centres, pivots)
        sums = np.zeros(centres.shape, np.int64)
        counts = np.zeros(len(centres), np.int64)
        for _, points, near in _blocks(batches):
            cluster, _, _ = bounds.nearest(points, near)
            np.add.at(sums, cluster, points)
            counts += np.bincount(cluster, minlength=len(centres))
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(filled, pa.int32()),
                "n": pa.array(counts[filled]),
                "sums": pa.array(sums[filled].tolist(), pa.list_(pa.int64())),
            }
        )

    parts = cached.mapInArrow(run, "cluster int, n long, sums array<long>")
    added = (
        parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum("part").alias("total"), F.sum("n").alias("n"))
    )
    out = centres.copy()
    for r in added.collect():
        out[r["cluster"], r["place"]] = r["total"] // r["n"]
    return out


def assigned(cached: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(centres, pivots)
        for ids, points, near in _blocks(batches):
            cluster, distance, _ = bounds.nearest(points, near)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    return cached.mapInArrow(run, ASSIGNED)


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimension: int = DIMENSION,
    scale: int = SCALE,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """The cluster of every kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, centroid.

    Vectors become integers ``floor(scale * x)``. Centres start as the vectors with the smallest
    SHA-256 of ``seed:vec_id``; each of ``rounds`` rounds assigns all vectors (ties: the smaller
    number) and moves every centre that has any to their floored mean; then all are assigned once
    more. Distances are squared. ``centroid`` holds the final centre's components.

    NULL, NaN, infinite or missing components, NULL vectors and other lengths leave a vector out;
    a NULL ``vec_id`` is kept as it is. Rows with the same id are vectors of their own, and where
    they compete for a start the smaller vector goes first. With fewer vectors than clusters each
    vector starts one; an empty table gives an empty result. Equal vectors, however many, cost
    what others do. Components beyond 2**27 after scaling, whose squared distances need not fit 64
    bits, raise a ``ValueError``; a sum of distances that does not fit is NULL. Other columns are
    ignored, whatever their names.

    The driver holds the centres and pivots; vectors and their pivot distances stay in the table.
    """
    points = materialize(kept_points(vectors, dimension, scale), "points")
    size = F.greatest(*(F.abs(f("point").cast("double")) for f in (F.array_max, F.array_min)))
    if (points.agg(F.max(size)).first()[0] or 0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    spark = points.sparkSession
    centres = np.array(first_points(points, str(seed), clusters), np.int64).reshape(-1, dimension)
    if not len(centres):
        return spark.createDataFrame(
            [],
            f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string,"
            " centroid array<long>",
        )
    pivots = pivots_of(points, n_pivots)
    cached = materialize(with_pivots(points, pivots), "pivot-distances")
    for _ in range(rounds):
        centres = moved(cached, centres, pivots)
    done = materialize(assigned(cached, centres, pivots), "assigned")
    return with_totals(done, centres)


def with_totals(done: DataFrame, centres: np.ndarray) -> DataFrame:
    """Assigned vectors with the sums of distances and their centres, one row per cluster of
    which is joined."""
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = done.groupBy("cluster").agg(wide.alias("part")).collect()
    total = sum(int(r["part"]) for r in sums)
    fits = lambda x: x if x < 1 << 63 else None
    named = done.sparkSession.createDataFrame(
        [(r["cluster"], fits(int(r["part"])), fits(total), centres[r["cluster"]].tolist()) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return done.join(F.broadcast(named), "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        digest.alias("centroid_sha256"),
        "centroid",
    )


def oracle(
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION,
    scale: int = SCALE,
) -> str:
    """DuckDB SQL for the rows of :func:`cluster_vectors` without ``centroid``."""
    apart = (
        f"list_sum(list_transform(range(1, {dimension + 1}),"
        " lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))::BIGINT"
    )

    def assign(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT id, any_value(vec_id) AS vec_id, any_value(p) AS p, min(best).k AS k, min(best).d AS d
  FROM (SELECT v.id, v.vec_id, v.p, struct_pack(d := {apart}, k := c.k) AS best
        FROM kept v CROSS JOIN c{k} c) GROUP BY id)"""

    def move(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (
  SELECT k, list(x ORDER BY i) AS p FROM (
    SELECT k, i, (s - ((s % n) + n) % n) // n AS x FROM (
      SELECT k, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
      FROM (SELECT k, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{k}) GROUP BY k, i))
  GROUP BY k
  UNION ALL SELECT k, p FROM c{k} WHERE k NOT IN (SELECT k FROM a{k}))"""

    steps = [s for k in range(rounds) for s in (assign(k), move(k))] + [assign(rounds)]
    parts = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p
  FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dimension}
),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), p) - 1)::INT AS k, p
  FROM kept QUALIFY k < {clusters}
),
{parts}
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia,
       sha256(list_aggregate(list_transform(c.p, lambda x: x::VARCHAR), 'string_agg', ','))
         AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)
"""
