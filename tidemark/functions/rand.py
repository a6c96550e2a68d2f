"""Random numbers that depend on nothing but their key.

A value drawn from ``(seed, series, position)`` is the same however rows are
partitioned and however often a lost task is run again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column, stream: str = "") -> Column:
    """Uniform in (0, 1) from a 64-bit hash; 52 bits are used, so 0 and 1 do not occur."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *parts), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *parts: Column, stream: str = "") -> Column:
    """Standard normal by the Box-Muller transform."""
    u, v = uniform(seed, *parts, stream=stream + "/r"), uniform(seed, *parts, stream=stream + "/a")
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def order_key(seed: int, *parts: Column) -> Column:
    """Sort key of a seeded shuffle."""
    return F.xxhash64(F.lit(seed), F.lit("shuffle"), *parts)
