"""Right-closed bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_right(value: Column, upper_edges: Sequence[float]) -> Column:
    """Index (from 0) of the right-closed bin ``(edge[i-1], edge[i]]`` a value falls in.

    ``upper_edges`` are the finite upper bounds in ascending order; the last bin is open above.
    NULL stays NULL.
    """
    last = len(upper_edges)
    chain = reduce(
        lambda acc, edge: acc.when(value <= F.lit(float(edge[1])), F.lit(edge[0])),
        enumerate(upper_edges),
        F.when(value.isNull(), F.lit(None).cast("int")),
    )
    return chain.otherwise(F.lit(last))


def label_of(index: Column, labels: Sequence[str]) -> Column:
    # Not element_at: with a NULL index it returns an element of an array without NULLs.
    return F.get(F.array(*[F.lit(label) for label in labels]), index)
