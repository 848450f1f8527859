"""Deterministic pseudo-randomness: a hash of a seed and a key, the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(seed: int, keys: tuple[Column, ...]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def hash_order(seed: int, *keys: Column) -> Column:
    """A sort key in place of a seeded shuffle."""
    return _joined(seed, keys)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1): the first 32 bits of the hash."""
    return F.conv(F.substring(_joined(seed, keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
