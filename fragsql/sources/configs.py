"""Configuration files of partitions, reducers and processor elements: comma-separated with a header."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# fixed values: the headers of the three kinds of file
PARTITION_COLUMNS = ("NODE", "MASTER", "DBURL", "USER", "PASSWORD", "MAPOUTPUT")
REDUCER_COLUMNS = ("ID", "NODE", "DBURL", "USER", "PASSWORD", "XFER_PORT", "SHUFFLE_DATASINK")
ELEMENT_COLUMNS = ("ID", "NODE", "MASTER", "DBURL", "USER", "PASSWORD", "MAPOUTPUT", "XFER_PORT", "SHUFFLE_DATASINK")


@dataclass
class Partition:
    node: str
    url: str
    user: str | None = None
    password: str | None = None
    map_output: str | None = None
    slaves: list[Partition] = field(default_factory=list)


@dataclass
class Reducer:
    id: str
    node: str
    url: str | None = None
    user: str | None = None
    password: str | None = None
    port: int | None = None
    sinks: list[str] = field(default_factory=list)
    uses: dict[str, int] = field(default_factory=dict)

    def sink(self) -> str | None:
        """The sink used least so far; of equal ones the first."""
        if not self.sinks:
            return None
        chosen = min(self.sinks, key=lambda s: self.uses.get(s, 0))
        self.uses[chosen] = self.uses.get(chosen, 0) + 1
        return chosen


def rows(spark: SparkSession, path: str, columns: Iterable[str]) -> list[dict[str, str | None]]:
    """The records of a configuration file by upper-case header; blank fields are None, a missing column is an error."""
    if not path.lower().endswith(".csv"):
        raise ValueError(f"only .csv files are read: {path}")
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*[c.strip().upper() for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return [{c: (r[c].strip() or None) if r[c] else None for c in df.columns} for r in df.collect()]


def partitions(records: Iterable[Mapping[str, str | None]]) -> list[Partition]:
    """Masters in the order of the file, each with its slaves. A slave may stand before its master, but needs one."""
    masters: dict[str, Partition] = {}
    slaves: list[tuple[str, Partition]] = []
    for r in records:
        if not r["NODE"] or not r["DBURL"]:
            raise ValueError("a partition needs NODE and DBURL")
        p = Partition(r["NODE"], r["DBURL"], r["USER"], r["PASSWORD"], r["MAPOUTPUT"])
        if r["MASTER"]:
            slaves.append((r["MASTER"], p))
        else:
            masters[p.node] = p
    for master, p in slaves:
        if master not in masters:
            raise ValueError(f"the master {master} of {p.node} isn't listed")
        masters[master].slaves.append(p)
    return list(masters.values())


def reducers(records: Iterable[Mapping[str, str | None]]) -> list[Reducer]:
    out = []
    for r in records:
        if not r["ID"] or not r["NODE"]:
            raise ValueError("a reducer needs ID and NODE")
        sinks = [s.strip() for s in (r["SHUFFLE_DATASINK"] or "").split(",") if s.strip()]
        out.append(Reducer(r["ID"], r["NODE"], r["DBURL"], r["USER"], r["PASSWORD"], int(r["XFER_PORT"]) if r["XFER_PORT"] else None, sinks))
    return out


def load_partitions(spark: SparkSession, path: str) -> list[Partition]:
    return partitions(rows(spark, path, PARTITION_COLUMNS))


def load_reducers(spark: SparkSession, path: str) -> list[Reducer]:
    return reducers(rows(spark, path, REDUCER_COLUMNS))


def load_elements(spark: SparkSession, path: str) -> tuple[list[Partition], list[Reducer]]:
    found = rows(spark, path, ELEMENT_COLUMNS)
    return partitions(found), reducers(found)
