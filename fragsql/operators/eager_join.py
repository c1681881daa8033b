"""Eager aggregation: aggregate both inputs by join key, join the compact states, then roll up.

A plain join followed by an aggregate moves every row of a hot key to one task and multiplies it by its partners.
Here each side first becomes one row per key: Spark combines on the map side, so a key that holds a third of all
rows arrives as one partial row per map task. The join is then one row against one row, and what the full join
would have summed is recovered by multiplying with the other side's row count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (kind, column); kind is one of sum, min, max, count (rows with a value), distinct.
Measures = Mapping[str, tuple[str, str | Column]]

_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "distinct": F.count_distinct}
_SCALED = {"sum", "count"}


def state(df: DataFrame, keys: Sequence[str], measures: Measures, rows: str) -> DataFrame:
    """One row per key: the number of rows and each measure. A distinct count is spread over (key, value) first."""
    aggs = [F.count(F.lit(1)).alias(rows)]
    aggs += [_AGG[kind](F.col(c) if isinstance(c, str) else c).alias(name) for name, (kind, c) in measures.items()]
    return df.groupBy(*keys).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_measures: Measures | None = None,
    right_measures: Measures | None = None,
    how: str = "inner",
    rollup: Sequence[str] | None = None,
    count: str = "n_joined",
) -> DataFrame:
    """What `left JOIN right USING (on) GROUP BY rollup` would give, without ever forming the joined rows.

    Returns the columns rollup (default: on), count (rows of the join; with an outer join a side without partner
    counts as one row) and one column per measure: sums and counts over the joined rows, minima, maxima and
    distinct counts. Measure names must differ between the sides.

    Nulls: a key with a null joins nothing, as in SQL; an outer join keeps it. A measure of a missing side is null.
    Repeated rows count as often as they occur. Empty inputs give no rows (inner). Other columns are ignored, so
    names in both inputs don't clash. A distinct count can't be rolled up to fewer keys; that raises ValueError.
    """
    left_measures, right_measures = dict(left_measures or {}), dict(right_measures or {})
    if set(left_measures) & set(right_measures):
        raise ValueError("measure names must differ between the sides")
    rollup = list(on if rollup is None else rollup)
    if not set(rollup) <= set(on):
        raise ValueError("rollup keys must be join keys")
    kinds = {name: kind for m in (left_measures, right_measures) for name, (kind, _) in m.items()}
    if set(rollup) != set(on) and "distinct" in kinds.values():
        raise ValueError("a distinct count can't be rolled up")
    nl, nr = "__rows_left", "__rows_right"
    joined = state(left, on, left_measures, nl).join(state(right, on, right_measures, nr), list(on), how)
    times = {**{name: F.coalesce(F.col(nr), F.lit(1)) for name in left_measures}, **{name: F.coalesce(F.col(nl), F.lit(1)) for name in right_measures}}
    cols = [F.col(k) for k in on] + [(F.coalesce(F.col(nl), F.lit(1)) * F.coalesce(F.col(nr), F.lit(1))).alias(count)]
    cols += [(F.col(name) * times[name] if kind in _SCALED else F.col(name)).alias(name) for name, kind in kinds.items()]
    joined = joined.select(*cols)
    if set(rollup) == set(on):
        return joined
    up = [F.sum(count).alias(count)] + [{"min": F.min, "max": F.max}.get(kind, F.sum)(name).alias(name) for name, kind in kinds.items()]
    return joined.groupBy(*rollup).agg(*up)
