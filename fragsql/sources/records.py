"""A data source from user-written record readers."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Split(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, function: str, options: dict[str, str]):
        module, _, name = function.partition(":")
        self.module, self.name, self.options = module, name, options

    def partitions(self) -> list[Split]:
        return [Split(i) for i in range(int(self.options.get("splits", "1")))]

    def read(self, partition: Split) -> Iterator[tuple]:
        yield from getattr(importlib.import_module(self.module), self.name)(partition.number, dict(self.options))


class RecordSource(DataSource):
    """spark.read.format("fragsql_records").schema(...).option("reader", "module:function").option("splits", n)

    function(split, options) gives the rows of one split, one after another; each split is read by a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "fragsql_records"

    def schema(self) -> str:
        raise ValueError("records need a schema")

    def reader(self, schema) -> _Reader:
        if "reader" not in self.options:
            raise ValueError("the option reader names a function as module:function")
        return _Reader(self.options["reader"], dict(self.options))


def numbers(split: int, options: dict[str, str]) -> Iterator[tuple]:
    """A reader for trials: `rows` numbers in each split."""
    rows = int(options.get("rows", "10"))
    yield from ((i,) for i in range(split * rows, (split + 1) * rows))
