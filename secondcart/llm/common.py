"""Helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
# Text that a Python worker handles at a time; what it builds on the way is some thirty times that.
SLICE_BYTES = 2 << 20


def exact_columns(df: DataFrame, *names: str) -> DataFrame:
    """Project to ``names`` by exact spelling and first position.

    Tables may carry further columns whose names differ only in case or are repeated; a plain
    ``select`` would call those ambiguous. A missing column becomes a NULL string.
    """
    found = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    return found.select(
        *[
            (found[f"_{at[n]}"] if n in at else F.lit(None).cast("string")).alias(n)
            for n in names
        ]
    )


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or a single longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False
        )
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    # Workers live on between tasks, and what Arrow's pool keeps would add up beside the heap.
    pa.default_memory_pool().release_unused()


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not total or starts.max() < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of every text, flat, and per text the offset of its first word. NULL has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not filled.all():
        before = offsets_of(filled)
        flat, offsets = flat.filter(pa.array(filled)), before[offsets]
    return flat, offsets


def codes(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and per word its index among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def joined(some: pa.Array, by: str = " ") -> str:
    """All strings of an array as one, much faster than by way of a Python list."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
    return pc.binary_join(whole, by)[0].as_py()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per range of ``offsets``; an empty range sums to 0."""
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        end = offsets[filled[-1] + 1]
        out[filled] = np.add.reduceat(values[:end], offsets[filled], dtype=np.int64)
    return out


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker keeps between tasks.

    The package's functions travel to executors by value, so module globals live for one task
    only; what is costly to build is kept on the interpreter itself.
    """
    kept = sys.__dict__.setdefault("_secondcart_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]
