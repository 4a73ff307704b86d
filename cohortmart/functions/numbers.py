"""Ratios, rounding and sums that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Two decimals, halves up, as binary floating point has them."""
    return F.floor(x * 100 + 0.5) / 100


def novelty(overlap: Column, players: Column) -> Column:
    return 1.0 - overlap.cast("double") / players


def similarity(plays: Column, cohort: Column) -> Column:
    return half_up(plays.cast("double") / cohort)


def _exact(x: Column, digits: int) -> Column:
    return x.cast(f"decimal(18,{digits})")


def mean(x: Column, digits: int | None = None) -> Column:
    """Mean; with `digits` decimals the sum is exact and the same in any order of rows."""
    if digits is None:
        return F.avg(x)
    return F.sum(_exact(x, digits)).cast("double") / F.count(x)


def total(x: Column, digits: int | None = None) -> Column:
    """The sum that mean_of() takes: of doubles, or with `digits` of whole numbers of the last decimal."""
    return F.sum(x) if digits is None else F.sum((_exact(x, digits) * 10**digits).cast("long"))


def mean_of(sums: Column, n: Column, digits: int | None = None) -> Column:
    """mean() from sums of total() and counts; null where nothing is counted."""
    whole = sums if digits is None else sums.cast("double") / 10**digits
    return F.when(n > 0, whole / n)


def deviation(x: Column, digits: int | None = None) -> Column:
    """Sample standard deviation, null for one row; with `digits` from exact sums."""
    if digits is None:
        return F.stddev_samp(x)
    s1, n = F.sum(_exact(x, digits)).cast("double"), F.count(x)
    s2 = F.sum((_exact(x, digits) * _exact(x, digits)).cast(f"decimal(38,{2 * digits})")).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), s2 - s1 * s1 / n) / (n - 1)))
