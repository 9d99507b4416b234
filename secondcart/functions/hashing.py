"""Seeded hashes that any SQL engine can reproduce, for stable splits, folds and draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH32_BITS = 32


def _md5_prefix(seed: int, tag: str, cols, digits: int) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def hash32(seed: int, tag: str, *cols) -> Column:
    """First 8 hex digits of ``md5(seed|tag|cols...)`` as an integer in [0, 2**32)."""
    return _md5_prefix(seed, tag, cols, 8)


def hash60(seed: int, tag: str, *cols) -> Column:
    """As :func:`hash32` with 15 digits: wide enough to address any row number."""
    return _md5_prefix(seed, tag, cols, 15)
