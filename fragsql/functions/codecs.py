"""Compression of single values, by name."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: limits of the LZF format, and the bytes of length before the stream
FARTHEST, LONGEST_REF, LONGEST_RUN, LENGTH_BYTES = 1 << 13, 264, 32, 3


def lzf_compress(data: bytes) -> bytes:
    """Three bytes of length, lowest first, and an LZF stream: runs of up to 32 bytes, and references to what came before."""
    if len(data) >= 1 << 8 * LENGTH_BYTES:
        raise ValueError("a value for LZF must be shorter than 16 MB")
    out, run, seen, i = bytearray(len(data).to_bytes(LENGTH_BYTES, "little")), 0, {}, 0

    def literals(end: int) -> None:
        for at in range(run, end, LONGEST_RUN):
            piece = data[at : min(at + LONGEST_RUN, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    while i < len(data):
        key = data[i : i + 3]
        ref, seen[key] = seen.get(key, -1), i
        back = i - ref - 1
        if len(key) < 3 or ref < 0 or back >= FARTHEST:
            i += 1
            continue
        n = 3
        while n < LONGEST_REF and i + n < len(data) and data[ref + n] == data[i + n]:
            n += 1
        literals(i)
        out.append(min(n - 2, 7) << 5 | back >> 8)
        if n - 2 >= 7:
            out.append(n - 9)
        out.append(back & 255)
        run = i = i + n
    literals(len(data))
    return bytes(out)


def lzf_decompress(data: bytes) -> bytes:
    size, i, out = int.from_bytes(data[:LENGTH_BYTES], "little"), LENGTH_BYTES, bytearray()
    while i < len(data):
        head, i = data[i], i + 1
        if head < LONGEST_RUN:
            out += data[i : i + head + 1]
            i += head + 1
            continue
        n = head >> 5
        if n == 7:
            n, i = n + data[i], i + 1
        at, i = len(out) - ((head & 31) << 8 | data[i]) - 1, i + 1
        if at < 0:
            raise ValueError("a reference before the first byte")
        for k in range(at, at + n + 2):  # it may reach into what it writes
            out.append(out[k])
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes were found, {size} were expected")
    return bytes(out)


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "lzf": (lzf_compress, lzf_decompress),
    "deflate": (zlib.compress, zlib.decompress),
}


def _apply(c: str | Column, f: Callable[[bytes], bytes]) -> Column:
    @F.pandas_udf("binary")
    def batch(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(bytes(v)))

    return batch((F.col(c) if isinstance(c, str) else c).cast("binary"))


def compress(c: str | Column, codec: str) -> Column:
    """Bytes (of text, its UTF-8) in a codec's format; null stays null. Whole tables are better compressed by Parquet."""
    return _apply(c, CODECS[codec.lower()][0])


def decompress(c: str | Column, codec: str) -> Column:
    return _apply(c, CODECS[codec.lower()][1])
