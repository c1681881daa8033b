"""Most frequent values by a three-phase threshold algorithm over local counts.

A node is a run of at most `chunk_rows` rows of one input partition; it counts its rows in memory that this bounds.
Only leaders, then values above a node's share of a proven threshold, ever leave a node; the hundreds of millions of
rare values are never shuffled. Nodes keep nothing between the phases: each phase reads the one column again, which is
less than writing all local counts would be, and leaves nothing to lose with an executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragsql.runtime import bounded_broadcast, stage

#: A node also ends when its values take so many bytes.
CHUNK_BYTES = 1 << 27


def _local_counts(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[tuple[int, pa.Table]]:
    """(rows, table of v and its count) of each node."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= chunk_rows or size >= CHUNK_BYTES:
            yield rows, pa.Table.from_batches(held).group_by("v").aggregate([([], "count_all")])
            held, rows, size = [], 0, 0
    if rows:
        yield rows, pa.Table.from_batches(held).group_by("v").aggregate([([], "count_all")])


def _emit(table: pa.Table, last: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from pa.table([table["v"], table["count_all"], pa.array(last, pa.int64())], schema=schema).to_batches(max_chunksize=10_000)


def frequent_items(df: DataFrame, column: str, k: int = 100, min_share: Fraction | None = None, chunk_rows: int = 1 << 20) -> DataFrame:
    """column, n, rank of the k most frequent values; with min_share, of those that hold at least this share of rows.

    1. Every node sends its k leaders and its number of rows. The k-th largest sum of what arrived is a lower bound
       of the k-th largest count (with min_share, that share of all rows is one too; the larger counts).
    2. Every node sends the values whose local count reaches its share of the bound, by its rows. A value sent by no
       node lies below the bound. Sums of what arrived raise the bound; each value's missing counts are limited by
       the shares of the nodes that didn't send it, and values that can't reach the bound are dropped.
    3. The remaining values are counted exactly over all rows, ranked by count, then by value.

    Counts are exact. A null is a value like any other (it ranks last of equal ones). Repeated rows count as often as
    they occur. An empty df gives no rows; with fewer than k different values all come out. min_share may let fewer
    than k values through, never more. Other columns are ignored, whatever their names. A column called n or rank
    comes out as value.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    src = df.select(F.col(column).alias("v"))
    kind = src.schema["v"].dataType

    def schema(third: str) -> T.StructType:
        return T.StructType([T.StructField("v", kind), T.StructField("n", T.LongType()), T.StructField(third, T.LongType())])

    def leaders(batches):
        for rows, counts in _local_counts(batches, chunk_rows):
            top = counts.take(pc.select_k_unstable(counts, k=min(k, counts.num_rows), sort_keys=[("count_all", "descending")]))
            yield from _emit(top, [rows] + [0] * (top.num_rows - 1), pa.schema([("v", top["v"].type), ("n", pa.int64()), ("rows", pa.int64())]))

    def kth(sums: DataFrame, n: str) -> int:
        least, number = sums.orderBy(F.col(n).desc()).limit(k).agg(F.min(n), F.count(F.lit(1))).first()
        return least if number == k else 1

    first = stage(src.mapInArrow(leaders, schema("rows")), "leaders")
    total = first.agg(F.sum("rows")).first()[0] or 0
    bound = kth(first.groupBy("v").agg(F.sum("n").alias("n")), "n")
    wanted = ceil(min_share * total) if min_share else 1
    bound = max(bound, wanted, 1)

    def above(batches):
        for rows, counts in _local_counts(batches, chunk_rows):
            share = max(1, bound * rows // total)
            sent = counts.filter(pc.greater_equal(counts["count_all"], share))
            if sent.num_rows:
                yield from _emit(sent, [share - 1] * sent.num_rows, pa.schema([("v", sent["v"].type), ("n", pa.int64()), ("could", pa.int64())]))

    second = stage(src.mapInArrow(above, schema("could")).groupBy("v").agg(F.sum("n").alias("n"), F.sum("could").alias("could")), "above")
    bound2 = max(bound, kth(second, "n"))
    # a value lacks at most the shares, less one, of the nodes that kept silent; all shares together are at most the bound
    hopeful = stage(second.where(F.col("n") + F.lit(bound) - F.col("could") >= bound2).select(F.col("v").alias("w")), "hopeful")

    exact = src.join(bounded_broadcast(hopeful), F.col("v").eqNullSafe(F.col("w")), "left_semi").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    best = exact.where(F.col("n") >= wanted).orderBy(F.col("n").desc(), F.col("v").asc_nulls_last()).limit(k)
    # k rows at most are left
    ranked = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("v").isNull().alias("last"), "v"))).alias("all"))
    return ranked.select(F.posexplode("all").alias("i", "r")).select(F.col("r.v").alias("value" if column in ("n", "rank") else column), (-F.col("r.m")).alias("n"), (F.col("i") + 1).alias("rank"))
