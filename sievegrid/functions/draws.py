"""Seeded pseudo-random numbers as a pure function of row keys.

``rand(seed)`` depends on partitioning and changes when a lost task is run
again elsewhere. Hashing (seed, keys) gives the same draw on every attempt and
in every plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform number in [0, 1) from a hash of the seed and the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return number / F.lit(float(2**52))


def pick(seed: int | str, n: Column, *keys: Column) -> Column:
    """Uniform integer in 0..n-1."""
    return F.floor(uniform(seed, *keys) * n).cast("bigint")


def geometric(p: float, u: Column) -> Column:
    """Number of trials up to the first success, from a uniform number."""
    return F.greatest(F.ceil(F.log(1 - u) / F.log(F.lit(1 - p))), F.lit(1)).cast("bigint")
