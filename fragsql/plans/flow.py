"""A small command language over partitions and reducers, and the processor that runs it.

    load partitions [into catalog "c"] from file "p.csv";
    load reducers [into catalog "c"] from file "r.csv";
    load processor elements [into catalog "c"] from file "e.csv";
    map-and-shuffle { select ...; } [catalog_name = "c"] [num_reducers = 4] [distributed by hash(col, ...)];
    map { any statements; } [catalog_name = "c"];
    reduce at PE { select ... from <src> ...; } [catalog_name = "c"];
    let $x := spawn { commands };   sync $x, $y;   sync all;

Keywords go in any letter case; -- and /* */ are comments; a closing brace within a body is written \\}.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fragsql.operators.catalog import SHARD, Catalog
from fragsql.plans.dialect import normalise
from fragsql.plans.script import is_select, split_script
from fragsql.plans.twophase import SOURCE, map_phase, run_script, table_views
from fragsql.sources import configs

DEFAULT = "default"


@dataclass
class Command:
    kind: str
    body: str = ""
    catalog: str = DEFAULT
    properties: dict[str, Any] = field(default_factory=dict)


class FlowError(ValueError):
    """A script that doesn't follow the grammar, or asks for what isn't there."""


class Parser:
    _SKIP = re.compile(r"(?:\s+|--[^\n]*|/\*.*?\*/)*", re.DOTALL)
    _NAME = re.compile(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|[A-Za-z_][A-Za-z_0-9.]*")

    def __init__(self, text: str):
        self.text, self.i = text, 0

    def _skip(self) -> None:
        self.i = self._SKIP.match(self.text, self.i).end()

    def _words(self, *words: str) -> bool:
        """Take these words if they come next."""
        begin = self.i
        for w in words:
            self._skip()
            m = re.compile(re.escape(w) + (r"\b" if w[-1].isalnum() else ""), re.IGNORECASE).match(self.text, self.i)
            if not m:
                self.i = begin
                return False
            self.i = m.end()
        return True

    def _fail(self, wanted: str) -> FlowError:
        line = self.text.count("\n", 0, self.i) + 1
        return FlowError(f"line {line}: {wanted} was expected at {self.text[self.i : self.i + 30]!r}")

    def _name(self, what: str) -> str:
        self._skip()
        m = self._NAME.match(self.text, self.i)
        if not m:
            raise self._fail(what)
        self.i = m.end()
        text = m.group()
        return text[1:-1].replace(text[0] * 2, text[0]) if text[0] in "\"'" else text

    def _variable(self) -> str:
        if not self._words("$"):
            raise self._fail("a variable")
        return self._name("a variable")

    def _braces(self) -> str:
        """The text between braces; only \\} doesn't close it."""
        if not self._words("{"):
            raise self._fail("{")
        out = []
        while self.i < len(self.text):
            ch = self.text[self.i]
            if ch == "\\" and self.text[self.i + 1 : self.i + 2] == "}":
                out.append("}")
                self.i += 2
                continue
            self.i += 1
            if ch == "}":
                return "".join(out).strip()
            out.append(ch)
        raise self._fail("}")

    def parse(self) -> list[Command]:
        out = []
        while True:
            self._skip()
            if self.i >= len(self.text):
                return out
            out.append(self._command())
            if not self._words(";"):
                raise self._fail(";")

    def _command(self) -> Command:
        for kind in ("partitions", "reducers", "elements"):
            words = ("processor", "elements") if kind == "elements" else (kind,)
            if self._words("load", *words):
                name = self._name("a catalog") if self._words("into", "catalog") else DEFAULT
                if self._words("from", "table"):
                    raise FlowError(f"load {kind} from table isn't supported")
                if not self._words("from", "file"):
                    raise self._fail("from file")
                return Command("load " + kind, self._name("a file"), name)
        if self._words("map-and-shuffle"):
            return self._options(Command("map-and-shuffle", self._select(self._braces())))
        if self._words("map"):
            return self._options(Command("map", self._braces()))
        if self._words("reduce", "at"):
            element = self._name("a processor element")
            return self._options(Command("reduce", self._select(self._braces()), properties={"element": element}))
        if self._words("let"):
            name = self._variable()
            if not self._words(":=") or not self._words("spawn"):
                raise self._fail(":= spawn")
            return Command("spawn", properties={"variable": name, "commands": self._block()})
        if self._words("sync", "all"):
            return Command("sync", properties={"variables": None})
        if self._words("sync"):
            names = [self._variable()]
            while self._words(","):
                names.append(self._variable())
            return Command("sync", properties={"variables": names})
        raise self._fail("a command")

    def _block(self) -> list[Command]:
        if not self._words("{"):
            raise self._fail("{")
        out = []
        while not self._words("}"):
            out.append(self._command())
            if not self._words(";"):
                raise self._fail(";")
        return out

    def _select(self, body: str) -> str:
        statements = split_script(body)
        if len(statements) != 1 or not is_select(statements[0]):
            raise FlowError("the body must be one SELECT")
        return statements[0].strip().rstrip(";").rstrip()

    def _options(self, command: Command) -> Command:
        while True:
            if self._words("catalog_name", "="):
                command.catalog = self._name("a catalog")
            elif self._words("num_reducers", "="):
                self._skip()
                m = re.compile(r"[1-9][0-9]*").match(self.text, self.i)
                if not m:
                    raise self._fail("a number")
                command.properties["num_reducers"], self.i = int(m.group()), m.end()
            elif self._words("distributed", "by", "hash", "("):
                keys = [self._name("a column")]
                while self._words(","):
                    keys.append(self._name("a column"))
                if not self._words(")"):
                    raise self._fail(")")
                command.properties["keys"] = keys
            else:
                return command


def parse(text: str) -> list[Command]:
    return Parser(text).parse()


@dataclass
class Module:
    partitions: list[configs.Partition] = field(default_factory=list)
    reducers: list[configs.Reducer] = field(default_factory=list)


class Processor:
    """Runs commands in order. Results: outputs has each map, shuffle and reduce result; variables the spawned ones."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], fragments: Catalog | None = None):
        self.spark, self.tables, self.fragments = spark, dict(tables), fragments
        self.catalogs: dict[str, Module] = {}
        self.outputs: list[tuple[Command, DataFrame | None]] = []
        self.shuffled: dict[str, DataFrame] = {}
        self.variables: dict[str, Future] = {}
        self._pool = ThreadPoolExecutor(4)

    def module(self, name: str) -> Module:
        return self.catalogs.setdefault(name, Module())

    def run(self, script: str | list[Command]) -> list[tuple[Command, DataFrame | None]]:
        for command in parse(script) if isinstance(script, str) else script:
            self.outputs.append((command, self._run(command)))
        return self.outputs

    def _run(self, c: Command) -> DataFrame | None:
        m = self.module(c.catalog)
        if c.kind == "load partitions":
            m.partitions += configs.load_partitions(self.spark, c.body)
        elif c.kind == "load reducers":
            m.reducers += configs.load_reducers(self.spark, c.body)
        elif c.kind == "load elements":
            found = configs.load_elements(self.spark, c.body)
            m.partitions, m.reducers = m.partitions + found[0], m.reducers + found[1]
        elif c.kind == "map":
            return self._script(c.body)
        elif c.kind == "map-and-shuffle":
            return self._shuffle(c, m)
        elif c.kind == "reduce":
            return self._reduce(c, m)
        elif c.kind == "spawn":
            commands = c.properties["commands"]
            self.variables[c.properties["variable"]] = self._pool.submit(lambda: [self._run(x) for x in commands])
        elif c.kind == "sync":
            names = c.properties["variables"]
            for name in list(self.variables) if names is None else names:
                if name not in self.variables:
                    raise FlowError(f"${name} isn't known")
                self.variables[name].result()
        return None

    def _script(self, body: str) -> DataFrame | None:
        out = None
        with table_views(self.spark, self.tables):
            for s in split_script(body):
                df = self.spark.sql(normalise(s.strip().rstrip(";")))
                out = df if is_select(s) else out
        return out

    def _shuffle(self, c: Command, m: Module) -> DataFrame:
        """The query on every partition; its rows are spread over the reducers by hash of keys, or evenly."""
        sharded = m.partitions and any(SHARD in df.columns for df in self.tables.values())
        out = map_phase(self.spark, c.body, self.tables, len(m.partitions) if sharded else None, self.fragments)
        number = c.properties.get("num_reducers") or len(m.reducers)
        keys = c.properties.get("keys", [])
        if number or keys:
            out = out.repartition(*([number] if number else []), *keys)
        self.shuffled[c.catalog] = out
        return out

    def _reduce(self, c: Command, m: Module) -> DataFrame:
        element = c.properties["element"]
        if m.reducers and element not in {r.id for r in m.reducers}:
            raise FlowError(f"there is no processor element {element}")
        if SOURCE in c.body and c.catalog not in self.shuffled:
            raise FlowError("nothing has been shuffled yet")
        view = f"shuffle_{uuid.uuid4().hex}"
        with table_views(self.spark, self.tables):
            if c.catalog in self.shuffled:
                self.shuffled[c.catalog].createOrReplaceTempView(view)
            return run_script(self.spark, c.body.replace(SOURCE, f"`{view}`"))

    # what a remote client may ask for

    def partitions(self, catalog: str = DEFAULT) -> list[configs.Partition]:
        return list(self.module(catalog).partitions)

    def delete_catalog(self, catalog: str) -> bool:
        """False if there was none."""
        self.shuffled.pop(catalog, None)
        return self.catalogs.pop(catalog, None) is not None

    def execute_query(self, sql: str) -> DataFrame | None:
        return self._script(sql)

    def execute_command(self, command: Command) -> DataFrame | None:
        return self.run([command])[-1][1]
