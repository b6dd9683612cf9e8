"""Sums and means that neither cut values nor depend on the order of rows where that can be had."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "DECIMAL(30,4)"


def lossless(column: str) -> Column:
    """Aggregate: whether every value is a number of at most four decimals that ``EXACT`` holds."""
    value = F.col(column)
    return F.bool_and(F.when(value.isNotNull(), F.coalesce(value.try_cast(EXACT).cast("double") == value.cast("double"), F.lit(False))))


def exact_sum(column: str) -> Column:
    """Sum in double precision: through decimals, so free of order, if they hold every value, and of the doubles as they are otherwise."""
    value = F.col(column)
    return F.when(lossless(column), F.sum(value.try_cast(EXACT)).cast("double")).otherwise(F.sum(value.cast("double")))


def exact_mean(column: str) -> Column:
    """Mean with the same rule as ``exact_sum``."""
    value = F.col(column)
    return F.when(lossless(column), F.avg(value.try_cast(EXACT)).cast("double")).otherwise(F.avg(value.cast("double")))
