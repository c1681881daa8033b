"""Map, combine and reduce by Python functions over key-value rows, in Arrow batches.

The functions see one record at a time, as user code of this kind does; Spark moves whole batches. Where the work is
an aggregate that DataFrames know, use those instead: they stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fragsql.operators.ring import Ring

Pair = tuple[Any, Any]
#: A combiner sees no fewer pairs than this at a time; smaller rests pass it by.
COMBINE_FROM = 512
BATCH = 10_000
_NAN = float("nan")


def _schema(schema: str | T.StructType, spark: SparkSession) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Values as Python holds them: null as None, NaN as NaN, integers of any size as they are, structs as dicts."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _same(key: Any) -> Any:
    """The key for comparisons: all NaN are one key, lists and dicts can be looked up."""
    if isinstance(key, float) and key != key:
        return _NAN
    if isinstance(key, dict):
        return tuple((k, _same(v)) for k, v in key.items())
    return tuple(map(_same, key)) if isinstance(key, (list, tuple)) else key


def _combined(pairs: Iterable[Pair], combiner: Callable[[Any, list], Iterable[Pair]] | None, buffer: int) -> Iterator[Pair]:
    if combiner is None:
        yield from pairs
        return
    held: list[Pair] = []

    def flush() -> Iterator[Pair]:
        if len(held) < COMBINE_FROM:
            yield from held
        else:
            by_key: dict[Any, tuple[Any, list]] = {}
            for k, v in held:
                by_key.setdefault(_same(k), (k, []))[1].append(v)
            for k, values in by_key.values():
                yield from combiner(k, values)
        held.clear()

    for pair in pairs:
        held.append(pair)
        if len(held) >= buffer:
            yield from flush()
    yield from flush()


def map_phase(
    df: DataFrame,
    process: Callable[..., Iterable[Pair]],
    schema: str | T.StructType,
    skip: Callable[..., bool] | None = None,
    combiner: Callable[[Any, list], Iterable[Pair]] | None = None,
    buffer: int = 1 << 16,
) -> DataFrame:
    """Key-value rows that process(*record) gives for each record of df; schema names and types key and value.

    skip(*record) true: the record is left out. combiner(key, values) sees what a task gave, buffer pairs at a time,
    grouped by key, and gives pairs instead. Nulls come as None, NaN as NaN, bigints exactly. Timestamps come with the
    zone UTC. An error in a function fails the job.
    """
    out = _schema(schema, df.sparkSession)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (p for r in _records(batches) if not (skip and skip(*r)) for p in process(*r))
        yield from _batches(_combined(pairs, combiner, buffer), arrow)

    return df.mapInArrow(run, out)


def reduce_phase(
    df: DataFrame,
    process: Callable[[Any, Iterator], Iterable[tuple]],
    schema: str | T.StructType,
    skip: Callable[..., bool] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Rows that process(key, values) gives for each key of df, whose first column is the key and second the value.

    A task reads its keys in order and hands values on as they come, so a key's values need not fit in memory; they
    come ordered by `order`, if given. skip(key, value) true: that value is left out; a key without values left isn't
    processed. Null is a key, and so is NaN.
    """
    out = _schema(schema, df.sparkSession)
    arrow = to_arrow_schema(out)
    key, value = df.columns[:2]

    def groups(pairs: Iterator[Pair]) -> Iterator[tuple]:
        for _, group in groupby(pairs, key=lambda p: _same(p[0])):
            first = next(group)
            yield from process(first[0], (v for _, v in chain([first], group)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (r[:2] for r in _records(batches) if not (skip and skip(*r[:2])))
        yield from _batches(groups(pairs), arrow)

    return df.select(key, value, *[c for c in order if c not in (key, value)]).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def map_reduce(
    df: DataFrame,
    mapper: Callable[..., Iterable[Pair]],
    shuffle_schema: str | T.StructType,
    reducer: Callable[[Any, Iterator], Iterable[tuple]],
    schema: str | T.StructType,
    combiner: Callable[[Any, list], Iterable[Pair]] | None = None,
) -> DataFrame:
    return reduce_phase(map_phase(df, mapper, shuffle_schema, combiner=combiner), reducer, schema)


def reduced_map(df: DataFrame, process: Callable[[Any, Iterator], Iterable[Pair]], schema: str | T.StructType) -> DataFrame:
    """A map over input grouped by key: process(key, values) gives key-value pairs for the next shuffle."""
    return reduce_phase(df, process, schema)


def output_keys(df: DataFrame, ring: Ring) -> DataFrame:
    """key, node, n: the different keys of a map's output, the node that each goes to, and its number of pairs."""
    key = df.columns[0]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, ring.column(F.col(key).cast("string")).alias("node"), "n")


def parse_or_null(parse: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """parse, with None instead of an error for a bad record."""

    def run(record: Any) -> Any:
        try:
            return parse(record)
        except (ValueError, TypeError, KeyError, IndexError):
            return None

    return run


def scatter(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """Output routed by key and written side by side, a file for each partition."""
    df.repartition(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def gather(df: DataFrame, table: str, mode: str = "errorifexists") -> None:
    """The outputs of all reducers in one table."""
    df.write.mode(mode).saveAsTable(table)


def gather_views(parts: Sequence[DataFrame], view: str) -> DataFrame:
    """A view over the tables of several jobs, put together with UNION ALL by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.createOrReplaceTempView(view)
    return out


def split_job(spark: SparkSession, items: Sequence[Any], work: Callable[[Any], Any], item_type: T.DataType, result_type: T.DataType) -> DataFrame:
    """item, result: each item is a task of its own, spread by hash; failed tasks are tried again by Spark."""
    df = spark.createDataFrame([(i,) for i in items], T.StructType([T.StructField("item", item_type)])).repartition(max(1, min(len(items), 200)), "item")
    out = T.StructType([T.StructField("item", item_type), T.StructField("result", result_type)])
    arrow = to_arrow_schema(out)
    return df.mapInArrow(lambda batches: _batches(((r[0], work(r[0])) for r in _records(batches)), arrow), out)


def aggregate_results(results: DataFrame, fold: Callable[[list], Any]) -> Any:
    """fold over the list of task results; for as many as there are tasks."""
    return fold([r["result"] for r in results.collect()])
