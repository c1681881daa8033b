"""Filling containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragsql.llm.tokens import VOCABULARY, token_count
from fragsql.runtime import stage


def fullest(available: Counter[int], space: int) -> Counter[int]:
    """The multiset of available sizes with the largest sum within space, by subset sums kept as the bits of one integer."""
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    for size in sorted(available, reverse=True):
        left, times = min(available[size], space // size), 1
        while left:  # a size that occurs often is cut into 1, 2, 4 ... copies of it
            take = min(times, left)
            steps.append((size, take, reach))
            reach |= reach << (size * take) & mask
            left, times = left - take, times * 2
        if reach >> space & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] += take
            total -= size * take
    return chosen


def minimum_bin_slack(sizes: dict[int, int], capacity: int) -> Iterator[tuple[Counter[int], int]]:
    """(sizes of a container, how many such containers): each holds the largest size left and fills its space best."""
    left = Counter({s: n for s, n in sizes.items() if n})
    while left:
        seed = max(left)
        left[seed] -= 1
        bin_ = fullest(left, capacity - seed)
        bin_[seed] += 1
        left[seed] += 1
        times = min(left[s] // n for s, n in bin_.items())
        for s, n in bin_.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        yield bin_, times


def pack(
    df: DataFrame,
    id_: str,
    size: str,
    capacity: int = 2048,
    pool_size: int = 1 << 21,
) -> DataFrame:
    """id, piece (from 0), n_pieces, size, container of every item of df (columns id_ and size).

    An item within the capacity stays whole. A larger one is split into full pieces, each a container of its own, and
    a rest that is packed like any item. Items go to pools of about pool_size in total by a hash of id and place in
    the input; each pool is packed by minimum bin slack, so that no task holds more than a pool, and at most the last
    few containers of each pool have space left.

    Sizes of null count as 0. Items of size 0 need no container: theirs is null, as is that of negative ones (which
    count as 0). A null id is an item like others. Rows with the same id are items of their own. An empty df gives
    no rows; other columns are ignored.
    """
    items = df.select(F.col(id_).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("total"), F.monotonically_increasing_id().alias("rid"))
    items = stage(items, "items")
    total = items.agg(F.sum("total")).first()[0] or 0
    pools = max(1, ceil(total / pool_size))
    full = F.floor((F.greatest("total", F.lit(1)) - 1) / F.lit(capacity))
    pieces = items.withColumn("n_pieces", (full + 1).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * F.lit(capacity))).drop("total")
    loose = (F.col("size") > 0) & (F.col("size") < capacity)
    alone = pieces.where(~loose).withColumn("container", F.when(F.col("size") > 0, F.format_string("full-%d-%d", "rid", "piece")))

    def fill(key: tuple, part: pa.Table) -> pa.Table:
        part = part.drop_columns(["pool"]).sort_by([("size", "ascending"), ("rid", "ascending"), ("piece", "ascending")])
        sizes, first, count = np.unique(part["size"].to_numpy(), return_index=True, return_counts=True)
        following = dict(zip(sizes.tolist(), first.tolist(), strict=True))
        container = np.empty(part.num_rows, np.int64)
        number = 0
        for bin_, times in minimum_bin_slack(dict(zip(sizes.tolist(), count.tolist(), strict=True)), capacity):
            for s, n in bin_.items():
                at = following[s]
                container[at : at + n * times] = np.repeat(np.arange(number, number + times), n)
                following[s] = at + n * times
            number += times
        name = f"pool-{key[0].as_py()}-"
        return part.append_column("container", pa.array([name + str(c) for c in container.tolist()], pa.string()))

    pooled = pieces.where(loose).withColumn("pool", F.pmod(F.xxhash64("rid", "id"), F.lit(pools)))
    packed = pooled.groupBy("pool").applyInArrow(fill, alone.schema)
    out = packed.unionByName(alone)
    return out.select(F.col("id").alias(id_), "piece", "n_pieces", F.col("size").alias("size"), "container")


def pack_texts(df: DataFrame, id_: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """pack() of whole texts, measured in tokens; a null or empty text has size 0."""
    sized = df.select(F.col(id_).alias("id"), token_count(text, vocabulary).alias("size"))
    return pack(sized, "id", "size", capacity).withColumnRenamed("id", id_)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """container, items, used and slack of each container."""
    used = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
    return used.withColumn("slack", F.lit(capacity) - F.col("used"))
