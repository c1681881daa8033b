"""Which tables are fragmented, by which keys, on which nodes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

#: The column of a fragment that says why this copy of a row is here.
HIDDEN = "_hidden"
#: The column of a fragment that says where it is.
SHARD = "_shard"
#: Bits of a non-negative INT.
MOST_TABLES = 31
#: After a table's name: its copies placed by a key to itself, and those kept beside rows that refer to them.
SELF, KEPT = "@self", "@kept"


@dataclass(frozen=True)
class TableSpec:
    """A table's primary key and its foreign keys (columns -> referenced table); keys may have several columns."""

    name: str
    pk: tuple[str, ...]
    fks: tuple[tuple[tuple[str, ...], str], ...] = ()


class NodeState(Enum):
    # fixed values: the numbers that catalog tables hold
    NORMAL = 0
    MAINTENANCE = 1
    SUSPECTED = -2
    DEAD = -1

    @property
    def valid(self) -> bool:
        """Whether tasks may be sent to the node's data: it works, or is only being looked after."""
        return self in (NodeState.NORMAL, NodeState.MAINTENANCE)


@dataclass
class Catalog:
    """Registered tables with their ids, and masters with their slaves for each distribution key ('' is the default)."""

    specs: dict[str, TableSpec] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)
    nodes: dict[tuple[str, str], str | None] = field(default_factory=dict)
    states: dict[str, NodeState] = field(default_factory=dict)

    def register(self, specs: Iterable[TableSpec]) -> list[int]:
        """Ids of the tables, given in order of registration from 1; a table registered before keeps its id.

        A table that refers to itself takes two more ids: one for the copies placed by that key, one for those kept
        beside rows that refer to them. Its own bit then still finds every row once.
        """
        out = []
        for spec in specs:
            name = spec.name.lower()
            itself = [name + SELF, name + KEPT] if any(to.lower() == name for _, to in spec.fks) else []
            for n in (name, *itself):
                if n not in self.ids:
                    if len(self.ids) == MOST_TABLES:
                        raise ValueError(f"no more than {MOST_TABLES} tables")
                    self.ids[n] = len(self.ids) + 1
            self.specs[name] = spec
            out.append(self.ids[name])
        return out

    def key_bit(self, table: str, to: str, suffix: str = "") -> int:
        """The bit of the copies of table placed by a foreign key to another, or to itself."""
        own = table.lower() == to.lower()
        return 1 << (self.ids[table.lower() + (suffix or SELF)] - 1) if own else self.bit(to)

    def spec(self, table: str) -> TableSpec:
        if table.lower() not in self.specs:
            raise KeyError(f"table {table} isn't registered")
        return self.specs[table.lower()]

    def bit(self, table: str) -> int:
        """1 << (id - 1)."""
        self.spec(table)
        return 1 << (self.ids[table.lower()] - 1)

    def referencing(self, table: str) -> list[tuple[TableSpec, tuple[str, ...]]]:
        """(table, foreign key columns) of each key that refers to the table."""
        return [(s, cols) for s in self.specs.values() for cols, to in s.fks if to.lower() == table.lower()]

    def load_order(self) -> list[str]:
        """Referencing tables before those they refer to."""
        left, out = dict(self.specs), []
        while left:
            free = [n for n in left if not any(s.name.lower() in left and s.name.lower() != n for s, _ in self.referencing(n))]
            if not free:
                raise ValueError(f"foreign keys form a circle: {sorted(left)}")
            out += [left.pop(n).name for n in free]
        return out

    def bits_of(self, table: str, columns: Iterable[str]) -> list[int]:
        """The bit that each key column means: the table's own for the primary key, the referenced table's for a foreign key.

        A column that is a key by itself means that key, else the first key it is part of. `primarykey` means the
        primary key whatever its columns.
        """
        spec, out = self.spec(table), []
        keys = [(spec.pk, self.bit(spec.name)), *((cols, self.key_bit(spec.name, to)) for cols, to in spec.fks)]
        keys = [(tuple(x.lower() for x in cols), b) for cols, b in keys]
        for c in (c.lower() for c in columns):
            found = [b for cols, b in keys if cols == (c,)] or [b for cols, b in keys if c in cols]
            if c == "primarykey":
                found = [self.bit(spec.name)]
            if not found:
                raise ValueError(f"{c} is no key of {table}")
            if found[0] not in out:
                out.append(found[0])
        return out

    def add_node(self, node: str, master: str | None = None, distkey: str = "", state: NodeState = NodeState.NORMAL) -> None:
        self.nodes[distkey, node] = master
        self.states.setdefault(node, state)

    def masters(self, distkey: str = "") -> list[str]:
        return sorted(n for (k, n), m in self.nodes.items() if k == distkey and m is None)

    def slaves(self, master: str, distkey: str = "") -> list[str]:
        return sorted(n for (k, n), m in self.nodes.items() if k == distkey and m == master)

    def set_state(self, node: str, state: NodeState) -> NodeState | None:
        """The state before. The new one is kept for every node, known or not."""
        before = self.states.get(node)
        self.states[node] = state
        return before

    def load_nodes(self, rows: DataFrame) -> None:
        """Nodes from a table distkey, node, masternode, state, which has a row for each node and key; other states count as suspected."""
        known = {x.value: x for x in NodeState}
        for r in rows.select("distkey", "node", "masternode", "state").collect():
            self.add_node(r["node"], r["masternode"], r["distkey"], known.get(r["state"], NodeState.SUSPECTED))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The catalog as tables: (distkey, node, masternode, state) and (tablename, id)."""
        nodes = [(k, n, m, self.states[n].value) for (k, n), m in sorted(self.nodes.items())]
        ids = [(self.specs[t].name if t in self.specs else t, i) for t, i in self.ids.items()]
        return spark.createDataFrame(nodes, "distkey string, node string, masternode string, state smallint"), spark.createDataFrame(ids, "tablename string, id smallint")
