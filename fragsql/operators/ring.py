"""Consistent hashing: a ring of virtual nodes, for placements that should move little when nodes come and go."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _place(key: bytes) -> int:
    """The first eight bytes of SHA-1."""
    return int.from_bytes(hashlib.sha1(key).digest()[:8], "big")


class Ring:
    """Nodes at `virtual` places each; a key belongs to the node at the first place after its own."""

    def __init__(self, nodes: Sequence[str], virtual: int = 128):
        if not nodes:
            raise ValueError("a ring needs a node")
        self.nodes, self.virtual = sorted(set(nodes)), virtual
        at = sorted((_place(f"{n}#{i}".encode()), k) for k, n in enumerate(self.nodes) for i in range(virtual))
        self.places = np.array([p for p, _ in at], np.uint64)
        self.owners = np.array([k for _, k in at], np.int64)

    def _index(self, key: bytes | str) -> int:
        return int(np.searchsorted(self.places, np.uint64(_place(key.encode() if isinstance(key, str) else key)), side="right"))

    def node(self, key: bytes | str) -> str:
        return self.nodes[self.owners[self._index(key) % len(self.owners)]]

    def successors(self, key: bytes | str, number: int, physical: bool = True) -> list[str]:
        """The owner and those that follow: different nodes, or with physical false the owners of the next places."""
        return self._from(self._index(key), number, physical)

    def _from(self, begin: int, number: int, physical: bool) -> list[str]:
        out = []
        for i in range(len(self.owners)):
            n = self.nodes[self.owners[(begin + i) % len(self.owners)]]
            if not physical or n not in out:
                out.append(n)
            if len(out) == number:
                break
        return out

    def column(self, key: str | Column) -> Column:
        """The owner of a key column (bytes, or text as UTF-8); null for null. The ring travels with the function."""
        return self.successor_column(key, 1)[0]

    def successor_column(self, key: str | Column, number: int, physical: bool = True) -> Column:
        """successors() of a key column, as an array; null for null. SHA-1 runs in the JVM, the search on whole batches."""
        after = [self._from(i, number, physical) for i in range(len(self.owners))]

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def owners(places: pd.Series) -> pd.Series:
            known = places.notna().to_numpy()
            at = np.frombuffer(b"".join(map(bytes, places[known])), ">u8")
            index = np.searchsorted(self.places, at.astype(np.uint64), side="right") % len(self.owners)
            out = pd.Series([None] * len(places), dtype=object)
            for i, k in zip(np.flatnonzero(known), index, strict=True):
                out.iat[i] = after[k]
            return out

        c = (F.col(key) if isinstance(key, str) else key).cast("binary")
        return owners(F.unhex(F.substring(F.sha1(c), 1, 16)))
