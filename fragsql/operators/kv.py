"""An ordered key-value store of named multimaps, kept as key-sorted Parquet.

An index is a directory of versions. Adding appends files to the current version; replacing and removing write a new
one by anti-join and then switch, so a reader always sees a whole index. Files are range-partitioned and sorted by
key, and predicates on the key are plain comparisons, which Parquet statistics use to skip row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragsql.operators.ring import Ring

SCHEMA = "key binary, value binary, seq bigint, node string, replica int"
Bytes = bytes | str
Pairs = DataFrame | Mapping[Bytes, Bytes] | Iterable[tuple[Bytes, Bytes]]


class Reply(NamedTuple):
    status: str
    key: bytes | None
    value: bytes | None


def _bytes(x: Bytes) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _end(prefix: bytes) -> bytes | None:
    """The first key after all that begin with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def predicate(op: str, *operands: Bytes, key: str = "key") -> Column:
    """A condition on a key, compared by unsigned bytes.

    any, eq, ne, gt, ge, lt, le; bw (low <= key <= high), bwx (low < key < high), nbw (key <= low or key >= high, so
    that bw and nbw share the bounds), nbwx (key < low or key > high, the complement of bw); in, not_in; start_with,
    not_start_with. A null key satisfies only any.
    """
    c, args = F.col(key), [F.lit(bytearray(_bytes(o))) for o in operands]
    simple = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}
    wanted = {"any": 0, "bw": 2, "bwx": 2, "nbw": 2, "nbwx": 2, "start_with": 1, "not_start_with": 1} | dict.fromkeys(simple, 1)
    if op in wanted and len(operands) != wanted[op]:
        raise ValueError(f"{op} takes {wanted[op]} operands")
    if op == "any":
        return F.lit(True)
    if op in simple:
        return getattr(c, simple[op])(args[0])
    if op in ("in", "not_in"):
        some = c.isin(*args) if args else c.isNotNull() & F.lit(False)
        return some if op == "in" else ~some
    if op in ("start_with", "not_start_with"):
        end = _end(_bytes(operands[0]))
        inside = (c >= args[0]) & (c < F.lit(bytearray(end))) if end is not None else c >= args[0]
        return inside if op == "start_with" else ~inside
    low, high = args if args else (None, None)
    if op == "bw":
        return (c >= low) & (c <= high)
    if op == "bwx":
        return (c > low) & (c < high)
    if op == "nbw":
        return (c <= low) | (c >= high)
    if op == "nbwx":
        return (c < low) | (c > high)
    raise ValueError(f"unknown predicate {op}")


LAYOUTS = ("ordered", "plain", "hashed")


class KVStore:
    """Named multimaps under one folder. Values of a key keep the order in which they were added.

    layout: ordered (by range of the key; a scan reads little), plain (as the rows come; every scan tests all keys) or
    hashed (a key's values together; keys can only be looked up). With a ring, a row is kept for the nodes that
    follow its key, and reads can leave out dead nodes; copies beyond the first are read only then.
    """

    def __init__(self, spark: SparkSession, root: str, layout: str = "ordered", ring: Ring | None = None):
        if layout not in LAYOUTS:
            raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
        self.spark, self.root, self.layout, self.ring = spark, root.rstrip("/"), layout, ring
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _current(self, index: str) -> str | None:
        """The version in use: the name of the newest marker file."""
        fs, at = self._fs(), self._path(index, "versions")
        if not fs.exists(at):
            return None
        return max((s.getPath().getName() for s in fs.listStatus(at)), default=None)

    def _switch(self, index: str, df: DataFrame | None) -> None:
        old = self._current(index)
        version = f"{int(old.split('-')[0]) + 1 if old else 0:012d}-{uuid.uuid4().hex[:8]}"
        at = "/".join((self.root, index, "data", version))
        (self.spark.createDataFrame([], SCHEMA) if df is None else self._sorted(df)).write.parquet(at)
        self._fs().create(self._path(index, "versions", version)).close()
        if old:
            self._fs().delete(self._path(index, "versions", old), False)
            self._fs().delete(self._path(index, "data", old), True)

    def _sorted(self, df: DataFrame) -> DataFrame:
        if self.layout != "ordered":
            return df.repartition("key") if self.layout == "hashed" else df
        return df.repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")

    def create(self, index: str) -> bool:
        """False if it was there already."""
        if self._current(index):
            return False
        self._switch(index, None)
        return True

    def drop(self, *indexes: str) -> None:
        for index in indexes:
            self._fs().delete(self._path(index), True)

    def names(self) -> list[str]:
        if not self._fs().exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path()))

    def purge_all(self, clear: bool) -> None:
        """Rewrite every index as few sorted files; with clear, drop them all."""
        if clear:
            self.drop(*self.names())
        else:
            self.sync(*self.names())

    def sync(self, *indexes: str) -> None:
        for index in indexes:
            if self._current(index):
                self._switch(index, self._copies(index))

    def table(self, index: str, without: Sequence[str] = ()) -> DataFrame:
        """key, value, seq, each pair once; no rows if there is no such index.

        without: nodes that are dead. A pair then comes from the first node that isn't; one kept by dead nodes alone
        is missing.
        """
        copies = self._copies(index)
        if not without:
            return copies.where("replica = 0").select("key", "value", "seq")
        alive = copies.where(F.col("node").isNull() | ~F.col("node").isin(*without))
        return alive.groupBy("key", "seq").agg(F.min_by(F.struct("value"), "replica").alias("v")).select("key", F.col("v.value").alias("value"), "seq")

    def _copies(self, index: str) -> DataFrame:
        version = self._current(index)
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet("/".join((self.root, index, "data", version)))

    def _rows(self, pairs: Pairs, index: str, nodes: Column | None) -> DataFrame:
        """Pairs with seq after all there are, a copy for each of nodes (null: one, of no node)."""
        if isinstance(pairs, DataFrame):
            df = pairs.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("seq"))
        else:
            items = pairs.items() if isinstance(pairs, Mapping) else pairs
            df = self.spark.createDataFrame([(bytearray(_bytes(k)), bytearray(_bytes(v)), i) for i, (k, v) in enumerate(items)], "key binary, value binary, seq bigint")
        last = self.table(index).agg(F.max("seq")).first()[0]
        df = df.withColumn("seq", F.col("seq") + F.lit(-1 if last is None else last) + F.lit(1))
        if nodes is None:
            return df.withColumns({"node": F.lit(None).cast("string"), "replica": F.lit(0)})
        return df.select("*", F.posexplode(nodes).alias("replica", "node")).select("key", "value", "seq", "node", "replica")

    def _nodes(self, replicas: int) -> Column | None:
        if self.ring is None:
            if replicas:
                raise ValueError("replicas need a ring of nodes")
            return None
        return self.ring.successor_column("key", 1 + replicas)

    def add(self, index: str, pairs: Pairs, replicas: int = 0) -> None:
        """Append values to keys, at 1 + replicas nodes of the ring. A DataFrame has key and value; its rows keep their order within a partition."""
        self._append(index, self._rows(pairs, index, self._nodes(replicas)))

    def add_at(self, index: str, pairs: Pairs, nodes: Sequence[str]) -> None:
        """Append values to keys, at the nodes named, whatever nodes the keys belong to."""
        if not nodes:
            raise ValueError("a node must be named")
        self._append(index, self._rows(pairs, index, F.array(*[F.lit(n) for n in nodes])))

    def add_node(self, index: str, keys: DataFrame | Iterable[Bytes], node: str) -> None:
        """Map keys to a node: its name is appended to each key's values."""
        if isinstance(keys, DataFrame):
            keys = keys.select("key", F.lit(node).alias("value"))
        self.add(index, keys if isinstance(keys, DataFrame) else [(k, node) for k in keys])

    def _append(self, index: str, rows: DataFrame) -> None:
        self.create(index)
        self._sorted(rows).write.mode("append").parquet("/".join((self.root, index, "data", self._current(index))))

    def add_records(self, index: str, df: DataFrame, key: Sequence[str]) -> None:
        """Append whole rows as JSON under the key made of some of their columns, joined with |."""
        name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
        self.add(index, df.select(name.alias("key"), F.to_json(F.struct(*df.columns)).alias("value")))

    def records(self, index: str, schema: str) -> DataFrame:
        """The rows that add_records stored; a value that isn't such a row gives nulls."""
        return self.table(index).select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")

    def put(self, index: str, pairs: Pairs, replicas: int = 0) -> None:
        """Replace all values of the given keys; of a key given twice the last value stays."""
        new = self._rows(pairs, index, self._nodes(replicas))
        new = new.groupBy("key", "replica").agg(F.max_by(F.struct("value", "node"), "seq").alias("v"), F.max("seq").alias("seq")).select("key", F.col("v.value").alias("value"), "seq", F.col("v.node").alias("node"), "replica")
        old = self._copies(index).join(new.select("key"), "key", "left_anti").select(*new.columns)
        self._switch(index, old.unionByName(new))

    def remove(self, index: str, *keys: Bytes) -> bool:
        """True if all keys were there; False also for an unknown index."""
        if not self._current(index):
            return False
        gone = {_bytes(k) for k in keys}
        found = self.table(index).where(predicate("in", *gone)).select("key").distinct().count()
        if found:
            self._switch(index, self._copies(index).where(predicate("not_in", *gone)))
        return found == len(gone)

    def scan(self, index: str, op: str = "any", *operands: Bytes, limit: int | None = None) -> DataFrame:
        """Pairs whose key satisfies a predicate, ordered by key, then by order of adding.

        limit: the scan stops after so many pairs, and each task keeps no more of them.
        """
        if self.layout == "hashed" and op not in ("any", "eq", "in"):
            raise NotImplementedError(f"a hashed store has no {op}: keys can only be looked up")
        out = self.table(index).where(predicate(op, *operands)).orderBy("key", "seq")
        return (out if limit is None else out.limit(limit)).select("key", "value")

    def exact_search(self, index: str, key: Bytes) -> DataFrame:
        return self.scan(index, "eq", key)

    def prefix_search(self, index: str, prefix: Bytes) -> DataFrame:
        return self.scan(index, "start_with", prefix)

    def get(self, index: str, key: Bytes) -> list[bytes]:
        """All values of a key, on the driver; exact_search is the form for keys with very many."""
        return [bytes(r["value"]) for r in self.exact_search(index, key).collect()]

    def multi_get_rows(self, index: str, keys: Sequence[Bytes] | DataFrame) -> DataFrame:
        """key, value, seq of the given keys, a row for each value: the form for keys with very many values."""
        t = self.table(index)
        if isinstance(keys, DataFrame):
            return t.join(keys.select("key").distinct(), "key", "left_semi")
        return t.where(predicate("in", *keys))

    def multi_get(self, index: str, keys: Sequence[Bytes] | DataFrame) -> DataFrame:
        """key, values (in order of adding) of the given keys; keys without values have no row."""
        found = self.multi_get_rows(index, keys)
        return found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]).alias("values"))

    # the commands of the cache protocol's gateway

    def handle_set(self, index: str, key: Bytes, value: Bytes) -> None:
        self.put(index, {key: value})

    def handle_get(self, index: str, key: Bytes) -> bytes | None:
        row = self.exact_search(index, key).first()
        return None if row is None else bytes(row["value"])

    def handle(self, command: str, index: str, key: Bytes = b"", value: Bytes = b"") -> Reply | None:
        """get, getk, set and their quiet forms with a q at the end, and quitq, in any letter case.

        getk tells the key too. A quiet get says nothing if the key isn't there, a quiet set nothing if it went well,
        quitq never anything.
        """
        name = command.lower()
        if name in ("get", "getk", "getq", "getkq"):
            found = self.handle_get(index, key)
            if found is None:
                return None if name.endswith("q") else Reply("not found", None, None)
            return Reply("ok", _bytes(key) if name.startswith("getk") else None, found)
        if name in ("set", "setq"):
            self.handle_set(index, key, value)
            return None if name == "setq" else Reply("ok", None, None)
        if name == "quitq":
            return None
        raise ValueError(f"unknown command {command}")
