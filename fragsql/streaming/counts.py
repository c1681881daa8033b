"""Running counts over a stream of accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, key: str, time: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, key, n for each window of event time; a window is final once the watermark, `late` behind, has passed it.

    Rows later than that are dropped, as a stream's state must end somewhere. Where no row may be lost, however late,
    use partial_counts and total_counts.
    """
    marked = stream.withWatermark(time, late)
    counted = marked.groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def partial_counts(stream: DataFrame, keys: list[str], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch's counts by keys to a table, under the batch's number, so that a batch that is run
    again replaces what it wrote before. total_counts adds them up; the state is the table, not memory."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def total_counts(partial: DataFrame, keys: list[str]) -> DataFrame:
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"))
