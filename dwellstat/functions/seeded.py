"""Seeded order keys: a shuffle that is the same under any partitioning and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed, *cols) -> Column:
    """Hex digest of the seed and the key columns; sorting by it is a reproducible shuffle."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_bucket(key: Column, digits: int = 3) -> Column:
    """Leading hex digits as a number: uniform buckets that keep the digest's order."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def hashed_fold(seed, key, folds: int) -> Column:
    """Fold number 0..folds-1 from the row key, independent of row order."""
    return F.pmod(F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
