"""Positions of rows within ordered groups of any size, row numbers, and exact medians, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragsql.runtime import bounded_broadcast, stage

#: Steps that a power of two is cut into by value_bucket.
PER_POWER = 32


def value_bucket(value: str | Column) -> Column:
    """A bigint that never falls while the number rises, about 3 % wide; NaN highest, null null."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    # bounds below keep infinite values and the smallest ones within a bigint, 0 lies between the signs
    size = F.floor(F.log2(F.least(F.abs(x), F.lit(1e308))) * PER_POWER).cast("long") + 1100 * PER_POWER
    return F.when(F.isnan(x), 1 << 40).when(x == 0, 0).when(x < 0, -size).otherwise(size)


def _joined(groups: Sequence[str], other: str) -> Column:
    on = F.lit(True)
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"{other}{i}"))
    return on


def number_rows(df: DataFrame, number: str = "row") -> DataFrame:
    """Add the place (from 1) of each row in the order in which df has its partitions and rows, e.g. after orderBy.

    The rows are staged, then the few partitions' sizes give each its offset: no row moves to another partition.
    """
    numbered = stage(df.withColumn("__mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col("__mid"), 33)
    sizes = numbered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(sizes.select("__p", before.alias("__before")), "starts")
    place = F.col("__before") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(bounded_broadcast(starts), part == F.col("__p")).select(*df.columns, place.alias(number))


def with_positions(df: DataFrame, groups: Sequence[str], order: Sequence[str], pos: str = "pos", total: str | None = "n") -> DataFrame:
    """Add each row's position (from 1) within its group by `order`, and the group's number of rows.

    One range shuffle by groups and order cuts even a single huge group into many partitions. The sorted rows are
    staged with a row number, the few (group, partition) counts give each partition's offset, and a row's position
    is that offset plus its place in the partition. Rows equal in groups and order get positions in any order.
    Nulls sort first and form groups of their own. Repeated rows each get a position. An empty df gives no rows.
    Columns of df keep their names, but none may be called pos, total or begin with two underscores.
    """
    if clash := [c for c in df.columns if c in (pos, total) or c.startswith("__")]:
        raise ValueError(f"columns can't be called {', '.join(clash)}")
    keys = [*groups, *order]
    sorted_ = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(F.col("__mid"), 33)
    w = Window.partitionBy(*groups)
    starts = (
        sorted_.groupBy(*groups, part.alias("__part"))
        .agg(F.min("__mid").alias("__m0"), F.count(F.lit(1)).alias("__c"))
        .select(
            *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
            F.col("__part").alias("__p"),
            (F.coalesce(F.sum("__c").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1 - F.col("__m0")).alias("__shift"),
            F.sum("__c").over(w).alias("__total"),
        )
    )
    on = part == F.col("__p")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = [*[F.col(c) for c in df.columns], (F.col("__mid") + F.col("__shift")).alias(pos)]
    return sorted_.join(starts, on).select(*out, *([F.col("__total").alias(total)] if total else []))


def exact_median(df: DataFrame, groups: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """groups, out: the exact median of value in each group; of an even number of values, the mean of the middle two.

    Counts by value_bucket, combined before they move, tell in which bucket a group's middle lies; only the values of
    that bucket are looked at again, each different one with its count, so that neither a hot group nor a hot value
    is more than a few rows of the exchange. These are sorted by range over all groups, and only the partitions in
    which a middle lies are cumulated.

    Null values are left out; a group without values has no row; NaN is larger than any number. df is read twice.
    """
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col(value).alias("v"), value_bucket(value).alias("b"))
    w = Window.partitionBy(*names)
    upto = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*names, "b").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(upto)})
    first, last = F.ceil(F.col("n") / F.lit(2)), F.floor(F.col("n") / F.lit(2)) + 1
    # the middle two may lie in different buckets, between which there is nothing
    middle = counts.where((F.col("upto") >= first) & (F.col("upto") - F.col("c") < last))
    middle = middle.groupBy(*[F.col(n).alias(f"m{i}") for i, n in enumerate(names)]).agg(
        F.min("b").alias("low"), F.max("b").alias("high"), (F.min(F.col("upto") - F.col("c"))).alias("below"), F.max("n").alias("n"),
    )
    middle = bounded_broadcast(stage(middle, "middle"))
    near = rows.join(middle, _joined(names, "m") & F.col("b").between(F.col("low"), F.col("high"))).groupBy(*names, "v").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("below").alias("below"))
    ordered = stage(near.repartitionByRange(*names, "v").withColumn("part", F.spark_partition_id()), "near")
    parts = ordered.groupBy(*names, "part").agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.max("below").alias("below"))
    before = F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
    parts = parts.withColumn("before", before).where((F.col("before") + F.col("c") >= first) & (F.col("before") < last))
    parts = stage(parts.select(*[F.col(n).alias(f"p{i}") for i, n in enumerate(names)], F.col("part").alias("p"), "before"), "parts")
    found = ordered.join(bounded_broadcast(parts), _joined(names, "p") & (F.col("part") == F.col("p")))
    upto = F.sum("c").over(Window.partitionBy(*names, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    found = found.withColumn("upto", upto).where((F.col("upto") >= first) & (F.col("upto") - F.col("c") < last))
    middle_two = (F.min("v") + F.max("v")) / 2
    return found.groupBy(*names).agg(middle_two.alias("m")).toDF(*groups, out)
