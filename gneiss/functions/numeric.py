"""Rounding and bounded arithmetic with fixed tie rules on the binary value."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def half_even(x: Column, digits: int = 6) -> Column:
    """Rounds the binary product half to even."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def half_away(x: Column, digits: int = 6) -> Column:
    """Rounds the binary product half away from zero."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clip(x: Column) -> Column:
    return F.least(x, F.lit(1.0))


def saturating(a: Column, b: Column) -> Column:
    """a - b, never below zero."""
    return F.greatest(a - b, F.lit(0))


def wilson_lower(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 without trials."""
    p = F.greatest(F.least(F.try_divide(successes, trials), F.lit(1.0)), F.lit(0.0))
    spread = F.lit(z) * F.sqrt((p * (1 - p) + F.lit(z * z) / (4 * trials)) / trials)
    bound = F.greatest((p + F.lit(z * z) / (2 * trials) - spread) / (1 + F.lit(z * z) / trials), F.lit(0.0))
    return F.when(trials > 0, bound).otherwise(0.0)


def nearest_rank(column: str, share: float) -> Column:
    """Exact nearest-rank percentile."""
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


def log_share(x: Column, at: float) -> Column:
    """ln(1 + x) against ln(at), at most 1."""
    return clip(F.log1p(x) / F.lit(math.log(at)))
