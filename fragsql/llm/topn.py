"""Top N items within every group, by score histograms and an exact rank of what survives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragsql.runtime import BROADCAST_ROWS, bounded_broadcast, shuffle_partitions, stage

#: If thresholds are too many to be broadcast, those of groups above this fraction of all items are, which are no more.
MOST_LARGE = 50_000
TOP, BOTTOM = 1_000_000, -1_000_000


def score_bucket(score: Column, per_power: int = 8) -> Column:
    """A bucket that never falls while the score rises: per_power buckets for each power of two; NaN highest, null lowest."""
    x = score.cast("double")
    size = F.floor(F.log2(F.least(F.abs(x), F.lit(1e300)) + 1) * per_power).cast("int")
    return F.when(x.isNull(), BOTTOM).when(F.isnan(x), TOP).when(x < 0, -size).otherwise(size)


def top_n_per_group(
    df: DataFrame,
    groups: Sequence[str],
    score: str,
    ties: Sequence[str],
    n: int,
    min_items: int = 1,
    rank: str = "rank",
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """The n rows with the highest score of every group, with their rank (from 1); equal scores go by `ties`, ascending.

    A first pass counts each group's items by score bucket, which gives every group of more than n items the lowest
    bucket needed for n survivors; lower rows are dropped. Up to `bound` thresholds (and BROADCAST_BYTES) are
    broadcast and applied where the rows lie. Of more, those of the largest groups are, at most MOST_LARGE; the
    others meet their rows in the shuffle that the rank needs anyway.

    What is left is ranked exactly: every task first keeps n rows of each group, so even a group of equal scores is
    never sorted in one place. Spark does so up to windowGroupLimitThreshold rows; for a larger n, groups are first
    ranked in salted parts. Groups with fewer than min_items items are left out. df is read twice.

    Null scores rank last, NaN first; a null group value forms a group; null tie keys go first. Rows equal in score
    and ties are all kept apart and get different ranks, in any order. An empty df gives no rows. All columns of df
    stay, whatever their names; if one of them is called like `rank`, the rank's name gets underscores until it
    differs.
    """
    if n < 1 or min_items < 1:
        raise ValueError("n and min_items must be at least 1")
    names, keep = df.columns, max(n, min_items)
    # names of our own within, so that no column of df can clash
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    rows = df.toDF(*inner.values())
    keys, value = [inner[g] for g in groups], inner[score]
    items = rows.withColumn("bucket", score_bucket(F.col(value)))
    counts = items.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*keys)
    above = F.sum("m").over(w.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0))
    limits = (
        counts.withColumn("above", above)
        .groupBy(*[F.col(g).alias(f"g{i}") for i, g in enumerate(keys)])
        .agg(F.max(F.when(F.col("above") >= keep, F.col("bucket"))).alias("least"), F.sum("m").alias("items"))
    )
    limits = stage(limits.where(F.col("items") > keep), "limits")
    on = F.lit(True)
    for i, g in enumerate(keys):
        on &= F.col(g).eqNullSafe(F.col(f"g{i}"))

    def above_limit(items: DataFrame, limits: DataFrame) -> DataFrame:
        kept = items.join(limits, on, "left").where(F.col("least").isNull() | (F.col("bucket") >= F.col("least")))
        return kept.select(*items.columns)

    near = bounded_broadcast(limits, bound)
    if near is not limits:
        left = above_limit(items, near)
    else:
        # sizes add up to the number of items: at most MOST_LARGE groups can each hold more than 1/MOST_LARGE of them
        share = F.lit((limits.agg(F.sum("items")).first()[0] or 0) / MOST_LARGE)
        left = above_limit(above_limit(items, bounded_broadcast(limits.where(F.col("items") > share), MOST_LARGE)), limits.where(F.col("items") <= share).hint("shuffle_hash"))
    left = left.select(*rows.columns)
    order = [F.col(value).desc_nulls_last(), *[F.col(inner[t]).asc() for t in ties]]
    if keep > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salt = F.pmod(F.xxhash64(*keys, value, *[inner[t] for t in ties], F.spark_partition_id()), F.lit(shuffle_partitions(df.sparkSession)))
        parts = Window.partitionBy(*keys, "salt").orderBy(*order)
        left = left.withColumn("salt", salt).withColumn("place", F.row_number().over(parts)).where(F.col("place") <= keep).drop("salt", "place")
    best = left.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= keep)
    if min_items > 1:
        best = best.withColumn("most", F.max("place").over(w)).where(F.col("most") >= min_items).drop("most")
    while rank in names:
        rank += "_"
    return best.where(F.col("place") <= n).toDF(*names, rank)
