"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.functions.hashing import hash60
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.sources.writers import materialize

SEED = 42
# Without stated weights a source's target share grows as its number of rows to this power:
# between the sources' own shares (1) and equal shares (0).
FLATTEN = 0.5
# A Poisson draw is summed from draws of at most this mean, so that exp(-mean) stays a number.
MEAN_PER_DRAW = 64.0
# Rates of up to this many sources (a few hundred bytes each) are broadcast; more are joined.
BROADCAST_SOURCES = 5000
COPY = "_copy"


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None, flatten: float, epochs: float
) -> DataFrame:
    """Per source its number of rows, target share, mean repetition rate and Poisson table.

    ``weights`` need not sum to 1; a source without a weight gets none and so no rows. The rows
    of all sources together keep their expected number times ``epochs``.
    """
    counts = docs.groupBy("_source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(flatten))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        listed = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        known = F.create_map(*listed) if listed else F.expr("map('', 0D)")
        weight = F.coalesce(F.try_element_at(known, F.col("_source")), F.lit(0.0))
    rates = counts.withColumn("weight", weight)
    all_rows = rates.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights"))
    total = all_rows.first()
    rows, weights_sum = total["rows"] or 0, total["weights"] or 0.0
    if rows and not weights_sum:
        raise ValueError("no source of the table has a weight")
    share = F.col("weight") / F.lit(float(weights_sum or 1.0))
    rate = share * F.lit(float(epochs * rows)) / F.col("n")
    draws = F.greatest(F.lit(1.0), F.ceil(rate / MEAN_PER_DRAW)).cast("int")
    return (
        rates.withColumn("rate", rate)
        .withColumn("draws", draws)
        .withColumn("cdf", poisson_table(F.col("rate") / F.col("draws")))
        .select("_source", "n", "rate", "draws", "cdf")
    )


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is below 1e-18."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(
                acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)
            ).alias("cdf"),
        ),
    )
    return step["cdf"]


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a row's draws depend on: its id, or its text where it has no id."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    flatten: float = FLATTEN,
    epochs: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with every row repeated a Poisson number of times, in random order.

    The number of copies of a row inverts the Poisson distribution with its source's repetition
    rate at a uniform number hashed from the seed and the row's id; many rows get none. Each copy
    has its number, from 1, in the new last column ``_copy``. The order is global: copies go to
    partitions by a hash and are sorted by it there.

    A NULL source is a source of its own (weight key ``None`` is not possible; it gets weight 0 if
    weights are stated). Rows with the same id, and rows without id with the same text, repeat
    alike; repeated rows are copied each for itself. A NULL or empty text is copied like any other, a
    very long one moves once per copy. An empty table gives an empty result. All columns are passed
    on by position, so clashing names do no harm.
    """
    names = docs.columns
    at = {n: i for i, n in reversed(list(enumerate(names)))}
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own = {n: F.col(f"_{at[n]}") if n in at else F.lit(None).cast("string") for n in
           ("doc_id", "text", "source")}
    # A NULL source would match no row of the join.
    source = F.coalesce(F.concat(F.lit("s"), own["source"].cast("string")), F.lit("null"))
    rows = plain.withColumn("_source", source)
    if weights is not None:
        weights = {f"s{k}": w for k, w in weights.items()}
    rates = materialize(source_rates(rows.select("_source"), weights, flatten, epochs), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(rates), "_source", "left")
    else:
        rated = lookup_by_hot_key(rows, rates, "_source", "n")
    key = draw_key(own["doc_id"], own["text"])
    uniform = lambda j: hash60(seed, "mix", key, j) / F.lit(float(1 << 60))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")),
        F.lit(0),
        lambda n, j: n + F.size(F.filter(F.col("cdf"), lambda c: c <= uniform(j))),
    )
    copied = (
        rated.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    )
    order = F.xxhash64(F.lit(seed), key, F.col(COPY))
    return (
        copied.withColumn("_order", order)
        .select(*plain.columns, COPY, "_order")
        .repartition("_order")
        .sortWithinPartitions("_order")
        .select(*plain.columns, COPY)
        .toDF(*names, COPY)
    )


ORACLE = """
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight
                FROM documents GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM counts),
draws AS (SELECT source, rate, greatest(1, ceil(rate / 64.0))::INT AS draws FROM rates),
points AS (SELECT source, draws, rate / draws AS mean,
                  unnest(range(0, ceil(rate / draws + 12 * sqrt(rate / draws) + 24)::INT + 1)) AS k
           FROM draws),
tables AS (
  SELECT source, draws, list(cdf ORDER BY k) AS cdf FROM (
    SELECT source, draws, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1)))
           OVER (PARTITION BY source ORDER BY k) AS cdf FROM points)
  GROUP BY source, draws),
drawn AS (
  SELECT doc_id, unnest(range(1, draws + 1)) AS j, cdf
  FROM documents JOIN tables ON documents.source IS NOT DISTINCT FROM tables.source),
copies AS (
  SELECT doc_id, sum(len(list_filter(cdf, lambda c: c <=
           ('0x' || substr(md5('42|mix|' || doc_id || '|' || j), 1, 15))::BIGINT
           / 1152921504606846976.0)))::INT AS copies
  FROM drawn GROUP BY doc_id)
SELECT documents.*, unnest(range(1, copies + 1)) AS _copy
FROM documents JOIN copies USING (doc_id) WHERE copies > 0
"""
