"""Aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# One summary holds at most about this many samples whatever the group size, so a group with a third of
# all rows costs a few MB per task; groups up to this many rows come out exact.
ACCURACY = 100_000


def quantile(c: Column | str, p: float, accuracy: int = ACCURACY) -> Column:
    """Element of the group at rank ``ceil(p * n)``, from a mergeable summary of bounded size."""
    return F.percentile_approx(_col(c), p, accuracy)


def quantiles(c: Column | str, ps: Sequence[float], accuracy: int = ACCURACY) -> Column:
    """Several quantiles from one summary, as an array."""
    return F.percentile_approx(_col(c), list(ps), accuracy)


def geomean(c: Column | str) -> Column:
    """Geometric mean of the positive values."""
    c = _col(c)
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def pct_of_rows(condition: Column) -> Column:
    """Percentage of all rows of the group that meet the condition."""
    return F.try_divide(100.0 * F.count_if(condition), F.count(F.lit(1)))


def exact_mean(c: Column | str, scale: int | None = None) -> Column:
    """Mean.  With ``scale`` the sum is taken in DECIMAL, so that it does not depend on the order in which
    partitions arrive or on which tasks were run again."""
    c = _col(c)
    if scale is None:
        return F.avg(c)
    return F.try_divide(F.sum(c.cast(f"decimal(28,{scale})")).cast("double"), F.count(c))
