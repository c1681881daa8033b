"""Statistics of the numbers in an array column. Null elements are left out; null and empty arrays give null (sum: 0 if empty)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _values(c: str | Column) -> Column:
    return F.transform(F.array_compact(F.col(c) if isinstance(c, str) else c), lambda x: x.cast("double"))


def array_sum(c: str | Column) -> Column:
    return F.aggregate(_values(c), F.lit(0.0), lambda a, x: a + x)


def array_mean(c: str | Column) -> Column:
    return F.try_divide(array_sum(c), F.size(_values(c)))


def array_variance(c: str | Column) -> Column:
    """Of the sample, around the mean; null for fewer than two numbers."""
    v = _values(c)
    squares = F.aggregate(F.transform(v, lambda x: (x - array_mean(c)) * (x - array_mean(c))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(v) > 1, F.try_divide(squares, F.size(v) - 1))


def array_stddev(c: str | Column) -> Column:
    return F.sqrt(array_variance(c))


def array_least(c: str | Column) -> Column:
    return F.array_min(_values(c))


def array_most(c: str | Column) -> Column:
    return F.array_max(_values(c))
