"""Closed-form statistics: Wilson bound, age weight, deterministic audit sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_low(good: Column, n: Column, z: float = 1.645) -> Column:
    """Lower Wilson bound of a share; 0 without cases."""
    n, p = n.cast("double"), good.cast("double") / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n == 0, F.lit(0.0)).otherwise((centre - spread) / (1 + z * z / n))


def age_weight(months: Column, half_life: int = 12) -> Column:
    return F.pow(F.lit(0.5), F.floor(F.greatest(months, F.lit(0)) / half_life))


def sampled(prefix: str, key: Column, rate: float) -> Column:
    """Whether an audit takes a key: a digest of it, as a share of its range, lies under the rate."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(prefix), key.cast("string")), 256), 1, 13), 16, 10).cast("double")
    return head / F.lit(float(16**13)) < rate
