"""Command line: python -m fragsql execute|register|flow|job ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fragsql.operators.catalog import SHARD, Catalog, TableSpec
from fragsql.operators.jobs import JobConf, run_job
from fragsql.plans.flow import Processor
from fragsql.plans.twophase import Output, execute


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fragsql")
    p.add_argument("--data", help="a folder of NAME.parquet tables; only a job needs none")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("execute", help="run a map and a reduce query")
    e.add_argument("--map-query", required=True, help="a file")
    e.add_argument("--reduce-query", required=True, help="a file")
    e.add_argument("--pre-map", help="a file: the map query of a first job that gives one value")
    e.add_argument("--pre-reduce", help="a file")
    e.add_argument("--output-name")
    e.add_argument("--output-method", default="csvFile", help="csv, csvFile, table, view or scalarString")
    e.add_argument("--show-output", action="store_true")
    e.add_argument("--shards", type=int, help="the number of shards, if the tables are fragments")
    e.add_argument("--wait-spe", action="store_true", help="wait for slow tasks instead of starting them twice")
    e.add_argument("--failover", action="store_true", help="try failed tasks again instead of giving up at once")
    e.add_argument("--delegate", help="the master of the cluster that runs the queries")
    e.add_argument("--keys", action="append", default=[], help="table:pk[,pk]:fk[,fk]=table:..., in order of registration")
    f = sub.add_parser("flow", help="run a script of the flow language")
    f.add_argument("script", help="a file")
    JobConf.parser(sub.add_parser("job", help="map and reduce from database to database"))
    r = sub.add_parser("register", help="show the bits that tables get")
    r.add_argument("keys", nargs="+", help="as --keys")
    return p


def spec_of(text: str) -> TableSpec:
    """table:pk[,pk][:fk[,fk]=table ...]"""
    name, pk, *fks = text.split(":")
    return TableSpec(name, tuple(pk.split(",")), tuple((tuple(cols.split(",")), to) for cols, to in (f.split("=") for f in fks)))


def tables_in(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {p.name.removesuffix(".parquet"): spark.read.parquet(str(p)) for p in sorted(Path(folder).iterdir()) if p.name.endswith(".parquet")}


def settings(args: argparse.Namespace) -> dict[str, str]:
    """What execute's options mean to a new session; one that is there already keeps its own."""
    if args.command != "execute":
        return {}
    master = {"spark.master": args.delegate} if args.delegate else {}
    return master | {"spark.speculation": str(not args.wait_spe).lower(), "spark.task.maxFailures": "4" if args.failover else "1"}


def new_session(args: argparse.Namespace) -> SparkSession:
    return SparkSession.builder.appName("fragsql").config(map=settings(args)).getOrCreate()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.data and args.command != "job":
        parser().error("--data is needed")
    spark = spark or new_session(args)
    if args.command == "job":
        print(run_job(spark, JobConf.of(args)))
        return 0
    tables = tables_in(spark, args.data)
    if args.command == "register":
        catalog = Catalog()
        for text, id_ in zip(args.keys, catalog.register([spec_of(t) for t in args.keys]), strict=True):
            print(f"{spec_of(text).name}\t{id_}\t{1 << (id_ - 1)}")
        return 0
    if args.command == "flow":
        for command, df in Processor(spark, tables).run(Path(args.script).read_text()):
            print(command.kind)
            if df is not None:
                df.show(20, False)
        return 0
    catalog = Catalog()
    catalog.register([spec_of(t) for t in args.keys])
    read = lambda p: Path(p).read_text() if p else None
    shards = args.shards if any(SHARD in df.columns for df in tables.values()) else None
    method = Output.of(args.output_method)
    result = execute(spark, read(args.map_query), read(args.reduce_query), tables, shards, catalog if args.keys else None, read(args.pre_map), read(args.pre_reduce), method, args.output_name)
    print(result.value)
    if args.show_output and method in (Output.TABLE, Output.VIEW):
        spark.table(result.value).show(20, False)
    elif args.show_output and method is Output.CSV:
        spark.read.csv(result.value).show(20, False)
    return 0
