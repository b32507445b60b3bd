"""Repeatable random draws: functions of a key, so a lost task draws the same values again."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(key: Column, name: str, seed: int = 42) -> Column:
    """Uniform number in [0, 1) for a row key and a draw name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def normal(key: Column, name: str, seed: int = 42) -> Column:
    """Standard normal number (Box-Muller from two uniforms)."""
    a, b = uniform(key, name + "/a", seed), uniform(key, name + "/b", seed)
    return F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(2.0 * math.pi * b)


def choice(u: Column, values: list, weights: list[float] | None = None) -> Column:
    """Value whose share of the unit interval holds ``u``."""
    weights = weights or [1.0] * len(values)
    total, below, out = sum(weights), 0.0, None
    for value, weight in zip(values[:-1], weights[:-1]):
        below += weight / total
        out = F.when(u < below, F.lit(value)) if out is None else out.when(u < below, F.lit(value))
    last = F.lit(values[-1])
    return last if out is None else out.otherwise(last)
