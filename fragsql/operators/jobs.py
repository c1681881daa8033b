"""Jobs of independent tasks with a say over every result, and map-reduce jobs from database to database."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from enum import Enum
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from fragsql.operators.mapreduce import map_reduce, split_job
from fragsql.sources.csvio import read_jdbc, write_jdbc


class Policy(Enum):
    """What to do after a task's result: go on; go on, with slow tasks started twice; end with what there is; end at
    once without this result; run the task again; go on without this result."""

    CONTINUE = "continue"
    CONTINUE_WITH_SPECULATIVE_TASKS = "continue_with_speculative_tasks"
    RETURN = "return"
    CANCEL_RETURN = "cancel_return"
    FAILOVER = "failover"
    SKIP = "skip"


def default_policy(item: Any, result: Any, error: str | None) -> Policy:
    return Policy.CONTINUE if error is None else Policy.FAILOVER


def run_tasks(
    spark: SparkSession,
    items: Sequence[Any],
    work: Callable[[Any], Any],
    item_type: T.DataType,
    result_type: T.DataType,
    policy: Callable[[Any, Any, str | None], Policy] = default_policy,
    at_once: int | None = None,
    retries: int = 3,
) -> list[tuple[Any, Any]]:
    """(item, result) of the tasks whose result is kept, in the order of items.

    Tasks run in rounds of at_once (default: as many as there are cores); policy(item, result, error) then decides on
    each, in order. FAILOVER runs a task again in the next round, up to `retries` times, after which its error is
    raised. RETURN keeps the result and starts no more rounds; CANCEL_RETURN drops it and those after it. Tasks are
    started twice while they are slow if the session has spark.speculation, which no running session can change.
    """

    def tried(item: Any) -> dict[str, Any]:
        try:
            return {"result": work(item), "error": None}
        except Exception as e:  # the policy decides
            return {"result": None, "error": f"{type(e).__name__}: {e}"}

    kind = T.StructType([T.StructField("result", result_type), T.StructField("error", T.StringType())])
    at_once = at_once or spark.sparkContext.defaultParallelism
    left, tries, kept, ended = list(enumerate(items)), dict.fromkeys(range(len(items)), 0), {}, False
    while left and not ended:
        now, left = left[:at_once], left[at_once:]
        numbered = T.StructType([T.StructField("place", T.LongType()), T.StructField("item", item_type)])
        rows = split_job(spark, now, lambda x: tried(x["item"]), numbered, kind).collect()
        for row in sorted(rows, key=lambda r: r["item"]["place"]):
            place, (result, error) = row["item"]["place"], row["result"]
            said = policy(items[place], result, error)
            if said is Policy.CANCEL_RETURN:
                ended = True
                break
            if said is Policy.FAILOVER:
                tries[place] += 1
                if tries[place] > retries:
                    raise RuntimeError(f"task {items[place]!r} failed: {error}")
                left.insert(0, (place, items[place]))
            elif said is not Policy.SKIP:
                kept[place] = result
                if said is Policy.RETURN:
                    ended = True
    return [(items[place], kept[place]) for place in sorted(kept)]


@dataclass
class JobConf:
    """A map-reduce job from a database's query to a database's table; functions are named as module:function."""

    url: str
    query: str
    mapper: str
    shuffle: str
    reducer: str
    schema: str
    output: str
    output_url: str | None = None
    combiner: str | None = None
    driver: str | None = None
    append: bool = False
    options: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def parser(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p.add_argument("--url", required=True, help="of the database that is read")
        p.add_argument("--query", required=True)
        p.add_argument("--mapper", required=True, help="module:function, from a row to (key, value) pairs")
        p.add_argument("--shuffle", required=True, help="names and types of key and value")
        p.add_argument("--reducer", required=True, help="module:function, from a key and its values to rows")
        p.add_argument("--schema", required=True, help="names and types of the result")
        p.add_argument("--output", required=True, help="the table written")
        p.add_argument("--output-url", help="of the database written, if another")
        p.add_argument("--combiner", help="module:function")
        p.add_argument("--driver", help="the class of the database's driver")
        p.add_argument("--append", action="store_true", help="keep the rows that the table has")
        p.add_argument("--option", action="append", default=[], dest="options", help="name=value, of the reader, as partitionColumn")
        return p

    @classmethod
    def of(cls, args: argparse.Namespace) -> JobConf:
        values = {f.name: getattr(args, f.name) for f in fields(cls)}
        return cls(**values | {"options": dict(o.split("=", 1) for o in args.options)})


def _function(name: str | None) -> Callable | None:
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def run_job(spark: SparkSession, conf: JobConf) -> str:
    """Read, map, shuffle, reduce and write; returns the table's name."""
    driver = {"driver": conf.driver} if conf.driver else {}
    rows = read_jdbc(spark, conf.url, conf.query, **driver, **conf.options)
    out = map_reduce(rows, _function(conf.mapper), conf.shuffle, _function(conf.reducer), conf.schema, _function(conf.combiner))
    write_jdbc(out, conf.output_url or conf.url, conf.output, not conf.append, **driver)
    return conf.output


def execute_update(spark: SparkSession, url: str, sql: str, driver: str | None = None) -> int:
    """Run a statement that isn't a query in a database, on the driver; the number of rows it changed, 0 of a definition.

    An embedded database is the one that write_jdbc fills and read_jdbc reads on a cluster too.
    """
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.java.lang.Class.forName(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        statement = connection.createStatement()
        return statement.executeUpdate(sql)
    finally:
        connection.close()


def one_for_each(key: Any, *rest: Any) -> list[tuple[Any, int]]:
    """A mapper for counting by a row's first column."""
    return [(key, 1)]


def added_up(key: Any, values: Any) -> list[tuple[Any, int]]:
    """A reducer and combiner that sums."""
    return [(key, sum(values))]
