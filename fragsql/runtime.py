"""Session helpers: the shared folder, staged tables, size-checked broadcast."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes (of its rows as JSON text) up to which a side may be broadcast once it has been measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_staged: list[tuple[SparkSession, str]] = []
#: How many tables each call of release_staged() or end of staging() had to delete.
releases: list[int] = []


def session(app: str = "fragsql", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def one_process(spark: SparkSession) -> bool:
    """Whether the session's tasks run in the driver's own process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only a local session, whose one process is its own cluster, gets a temporary folder where that is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not one_process(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fragsql-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and lost executors cost nothing.

    partition_by: a directory for each value of this column, so that a filter on it reads no other; rows of a value
    are brought together first, those of a large one in several tasks. The files stay until release_staged(), the end
    of the surrounding staging() or the end of the Python process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fragsql-{name}-{uuid.uuid4().hex}"
    writer = (df.hint("rebalance", partition_by) if partition_by else df).write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def brief_stage(df: DataFrame, name: str, partition_bytes: int) -> Iterator[DataFrame]:
    """df staged until the block ends, to be read in partitions of so many bytes at most."""
    spark = df.sparkSession
    mine = (spark, f"{shared_dir(spark)}/fragsql-{name}-{uuid.uuid4().hex}")
    _staged.append(mine)
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", partition_bytes).parquet(mine[1])
        reader = spark.newSession()  # for a setting that others shouldn't get
        reader.conf.set("spark.sql.files.maxPartitionBytes", partition_bytes)
        yield reader.read.schema(df.schema).parquet(mine[1])
    finally:
        _staged[:] = [x for x in _staged if x != mine]
        _delete([mine])


def stage_in_turn(spark: SparkSession, parts: Iterable[Any], schema: StructType, name: str) -> DataFrame:
    """All rows of parts of this schema, each part asked for and written once the one before is; there may be none.

    parts are DataFrames of the JVM: Python's own are collected late, and with them all rows that they hold.
    """
    path = f"{shared_dir(spark)}/fragsql-{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write().mode("append").option("compression", "zstd").parquet(path)
        del part
    return spark.read.schema(schema).parquet(path)


def stage_side_by_side(parts: Sequence[DataFrame], name: str, at_once: int) -> DataFrame:
    """All rows of parts of the same columns (by position), each part written by a job of its own, at_once at a time."""
    spark, names, plain = parts[0].sparkSession, parts[0].columns, [f"c{i}" for i in range(len(parts[0].columns))]
    path = f"{shared_dir(spark)}/fragsql-{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    folders = [f"{path}/{i}" for i in range(len(parts))]
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(lambda x: x[0].toDF(*plain).write.option("compression", "zstd").parquet(x[1]), zip(parts, folders, strict=True)))
    return spark.read.schema(parts[0].toDF(*plain).schema).parquet(*folders).toDF(*names)


@contextmanager
def staging() -> Iterator[None]:
    """Delete what was staged within as soon as the block ends: with staging(): query(spark, d).write..."""
    before = set(_staged)
    try:
        yield
    finally:
        mine = [x for x in _staged if x not in before]
        _staged[:] = [x for x in _staged if x in before]
        releases.append(len(mine))
        _delete(mine)


def staged_tables() -> list[tuple[SparkSession, str]]:
    """Session and path of every staged table that is still there."""
    return list(_staged)


def release_staged() -> None:
    """Delete every staged table. DataFrames that still read one fail afterwards."""
    releases.append(len(_staged))
    gone, _staged[:] = list(_staged), []
    _delete(gone)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM is gone at exit
            pass


atexit.register(release_staged)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if it has at most so many rows and so many bytes; else leave the join to the planner.

    df should be a staged table, since it is measured here.
    """
    measured = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if measured[0] <= rows and measured[1] <= size else df


def shuffle_partitions(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def day_number(ms: str | Column) -> Column:
    """Days since 1970 (UTC) of milliseconds since 1970; null stays null. Independent of the session's time zone."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.floor(c / F.lit(86_400_000)).cast("int")


def day_string(number: str | Column) -> Column:
    """YYYY-MM-DD of a day number."""
    c = F.col(number) if isinstance(number, str) else number
    return F.date_from_unix_date(c).cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
