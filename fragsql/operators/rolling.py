"""Trailing-period totals: every daily total is exploded onto the output days it influences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragsql.runtime import stage


def rolling_totals(
    df: DataFrame,
    entity: str,
    day: str,
    value: str | Column | None = None,
    periods: Sequence[int] = (7, 30),
    first: int | Column | None = None,
    last: int | Column | None = None,
    rows_per_task: int = 50_000,
) -> DataFrame:
    """Totals and averages of each entity over trailing periods, for every day from first to last.

    df has one or more rows per entity and day; day is a day number (days since 1970); value is summed (null: rows
    are counted). Returns entity, day, total (of that day), and total_<p>, avg_<p> for each period p; a period of p
    days ends with the day itself, the average divides by p. Days without rows appear with zeros.

    Rows are added up per (entity, day) before anything moves by entity, so a hot entity is at most one row a day
    when its partition is formed; the explosion, the grouping and the calendar all use that one partitioning. The
    daily totals are staged and counted, so that there are as many partitions as they need, rows_per_task in each.
    first and last default to the first and last day of df and may be scalar columns. Rows outside first..last
    are ignored, as are rows whose day is null or whose entity is null; a null value counts as 0. Repeated rows
    count as often as they occur. An empty df gives no rows. Other columns are ignored.
    """
    amount = F.count(F.lit(1)) if value is None else F.coalesce(F.sum(value), F.lit(0))
    src = df.where(F.col(day).isNotNull() & F.col(entity).isNotNull())
    if first is None or last is None:
        bounds = src.agg(F.min(day), F.max(day)).first()
        first, last = (bounds[0] if first is None else first), (bounds[1] if last is None else last)
    first, last = (x if isinstance(x, Column) else F.lit(x).cast("int") for x in (first, last))
    longest = max(periods)
    daily = (
        src.where(F.col(day).between(first, last))
        .groupBy(F.col(entity).alias("__e"), F.col(day).cast("int").alias("__d"))
        .agg(amount.alias("__n"))
    )
    daily = stage(daily, "daily")
    daily = daily.repartition(max(1, -(-daily.count() // rows_per_task)), "__e")
    reach = F.least(last, F.col("__d") + F.lit(longest - 1))
    influence = daily.select("__e", "__d", "__n", F.explode(F.sequence("__d", reach)).alias("__o"))
    age = F.col("__o") - F.col("__d")
    zero = F.lit(0) if value is None else F.col("__n") * 0
    active = influence.groupBy("__e", "__o").agg(
        F.sum(F.when(age == 0, F.col("__n")).otherwise(zero)).alias("total"),
        *[F.sum(F.when(age < p, F.col("__n")).otherwise(zero)).alias(f"total_{p}") for p in periods],
    )
    # calendar rows: the days that no daily total of the entity reaches
    reached = F.flatten(F.transform(F.col("days"), lambda d: F.sequence(d, F.least(last, d + F.lit(longest - 1)))))
    kind = dict(active.dtypes)
    idle = (
        daily.groupBy("__e")
        .agg(F.collect_set("__d").alias("days"))
        .select("__e", F.explode(F.array_except(F.sequence(first, last), reached)).alias("__o"))
        .select("__e", "__o", *[F.lit(0).cast(kind[c]).alias(c) for c in active.columns[2:]])
    )
    out = active.unionAll(idle)
    return out.select(
        F.col("__e").alias(entity),
        F.col("__o").alias(day),
        "total",
        *[c for p in periods for c in (F.col(f"total_{p}"), (F.col(f"total_{p}") / F.lit(float(p))).alias(f"avg_{p}"))],
    )
