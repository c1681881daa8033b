"""Two-phase SQL: a map query on every shard, its results as one view, a reduce query over that view."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragsql.operators.catalog import SHARD, Catalog
from fragsql.plans.dialect import add_view_drop, normalise
from fragsql.plans.keyed import rewrite
from fragsql.plans.script import validate_script
from fragsql.runtime import stage_side_by_side
from fragsql.sources.csvio import write_csv_file

#: Stands for the results of the map phase (in a reduce query) or of the first job (in a map query).
SOURCE = "<src>"


class Output(Enum):
    CSV = "csv"
    TABLE = "table"
    VIEW = "view"
    SCALAR = "scalarstring"
    FRAME = "frame"

    @classmethod
    def of(cls, name: str | Output) -> Output:
        """By name in any letter case; csvFile is csv."""
        if isinstance(name, cls):
            return name
        lower = name.lower()
        return cls("csv" if lower == "csvfile" else lower)


@dataclass
class Result:
    """value: the DataFrame (frame), the path (csv), the name (table, view) or the text or None (scalar)."""

    value: Any
    seconds: dict[str, float] = field(default_factory=dict)


def run_script(spark: SparkSession, sql: str, catalog: Catalog | None = None) -> DataFrame:
    """The query of a script DDL* SELECT DDL*. Views are temporary; those after the query run once it is analyzed."""
    before, query, after = validate_script(sql)
    for s in before:
        spark.sql(normalise(rewrite(s, catalog) if catalog else s))
    out = spark.sql(normalise(rewrite(query, catalog) if catalog else query))
    for s in add_view_drop(after):
        spark.sql(normalise(s))
    return out


#: Views are found by name in the session while a query is analyzed; one call at a time may put its tables there.
_views = threading.RLock()
#: Map queries of up to so many shards form one plan; those of more are planned and run one by one, side by side.
UNION_SHARDS = 8


@contextmanager
def table_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Iterator[Callable[[int | None], None]]:
    """The tables as temporary views, whole or of one shard; afterwards the session has the views it had before."""

    def show(shard: int | None) -> None:
        for name, df in tables.items():
            (df if shard is None or SHARD not in df.columns else df.where(F.col(SHARD) == shard)).createOrReplaceTempView(name)

    with _views:
        before = {}
        for name in tables:
            with suppress(AnalysisException):
                if spark.catalog.getTable(name).isTemporary:
                    before[name] = spark.table(name)
        try:
            show(None)
            yield show
        finally:
            for name in tables:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)


def map_phase(spark: SparkSession, map_sql: str, tables: Mapping[str, DataFrame], shards: int | None = None, catalog: Catalog | None = None) -> DataFrame:
    """The map query over each shard of the fragmented tables, put together with UNION ALL.

    shards None: one map query over the tables as they are. Tables without _shard are seen whole by every shard. The
    filter on _shard prunes directories where the fragments were staged or saved by shard, so all shards together
    read the tables once. Up to UNION_SHARDS shards the union is one lazy plan. Beyond that, each shard's query is a
    plan of its own, as large as the query whatever the number of shards; UNION_SHARDS of them run at a time, and
    their results are staged and read as one table.
    """
    parts = []
    with table_views(spark, tables) as show:
        for i in [None] if shards is None else range(shards):
            show(i)
            parts.append(run_script(spark, map_sql, catalog))
    return reduce(DataFrame.union, parts) if len(parts) <= UNION_SHARDS else stage_side_by_side(parts, "mapped", UNION_SHARDS)


def execute(
    spark: SparkSession,
    map_sql: str,
    reduce_sql: str,
    tables: Mapping[str, DataFrame],
    shards: int | None = None,
    catalog: Catalog | None = None,
    pre_map: str | None = None,
    pre_reduce: str | None = None,
    output: str | Output = Output.FRAME,
    name: str | None = None,
) -> Result:
    """Run a pair of queries.

    In the reduce query every <src> becomes the view of the map results. With pre_map and pre_reduce, a pair that
    gives one value is run first and that value takes the place of the first <src> in the map query; it is an error
    if there is none. Output: frame (lazy), csv (a file `name`), table, view, or scalarString, which is the first
    column of the first row as text, None without rows.
    """
    output, seconds, began = Output.of(output), {}, time.monotonic()
    if pre_map is not None:
        if pre_reduce is None or SOURCE not in map_sql:
            raise ValueError(f"a first job needs a reduce query, and {SOURCE} in the map query")
        value = execute(spark, pre_map, pre_reduce, tables, shards, catalog, output=Output.SCALAR).value
        map_sql = map_sql.replace(SOURCE, "null" if value is None else value, 1)
        seconds["pre"] = time.monotonic() - began
    view = f"map_{uuid.uuid4().hex}"
    map_phase(spark, map_sql, tables, shards, catalog).createOrReplaceTempView(view)
    seconds["map plan"] = time.monotonic() - began
    with table_views(spark, tables):
        df = run_script(spark, reduce_sql.replace(SOURCE, f"`{view}`"))
    if output is Output.VIEW:
        df.createOrReplaceTempView(name or view + "_out")
        value = name or view + "_out"
    elif output is Output.TABLE:
        value = name or view + "_out"
        df.write.saveAsTable(value)
    elif output is Output.CSV:
        value = write_csv_file(df, name or f"{view}.csv")
    elif output is Output.SCALAR:
        row = df.first()
        value = None if row is None or row[0] is None else _text(row[0])
    else:
        value = df
    if output is not Output.VIEW:  # a view still reads the map view's plan, which it holds itself
        spark.catalog.dropTempView(view)
    seconds["all"] = time.monotonic() - began
    return Result(value, seconds)


def _text(value: Any) -> str:
    """A value as SQL text; a float keeps its precision and stays a double."""
    return f"{value!r}d" if isinstance(value, float) else str(value)

