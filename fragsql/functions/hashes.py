"""Hash functions by name, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the published FNV parameters
FNV32_START = 0x811C9DC5
FNV32_PRIME = 0x01000193
FNV64_START = 0xCBF29CE484222325
FNV64_PRIME = 0x00000100000001B3


# fixed values: what the seeded families start from, and the published constants of theirs
SEED = 0xDEADBEEF
LOOKUP3_START = 0xDEADBEEF
GOLDEN64 = 0x9E3779B97F4A7C13
MURMUR32 = 0x5BD1E995
MURMUR64 = 0xC6A4A7935BD1E995
LOOKUP3_MIX = ((0, 2, 4, 1), (1, 0, 6, 2), (2, 1, 8, 0), (0, 2, 16, 1), (1, 0, 19, 2), (2, 1, 4, 0))
LOOKUP3_END = ((2, 1, 14), (0, 2, 11), (1, 0, 25), (2, 1, 16), (0, 2, 4), (1, 0, 14), (2, 1, 24))
LOOKUP8_MIX = (43, -9, 8, 38, -23, 5, 35, -49, 11, 12, -18, 22)

#: bytes (a line for each value, filled up with zeros to a multiple of 24), lengths -> hashes
Batch = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _in_batches(values: Sequence[bytes | None], f: Batch) -> list[int | None]:
    """f over values of about the same length at a time, so that few bytes are filling; null stays null."""
    sizes = np.array([-1 if v is None else len(v) for v in values])
    out: list[int | None] = [None] * len(values)
    level = np.where(sizes < 0, -1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
    for k in np.unique(level[level >= 0]):
        at = np.flatnonzero(level == k)
        width = -(-int(max(sizes[at].max(), 1)) // 24) * 24
        rows = np.frombuffer(b"".join(bytes(values[i]).ljust(width, b"\0") for i in at), np.uint8).reshape(len(at), width)
        with np.errstate(over="ignore"):
            for i, h in zip(at, f(rows, sizes[at]).tolist(), strict=True):
                out[i] = h
    return out


def _column(f: Batch) -> Callable[[Column], Column]:
    @F.pandas_udf(T.LongType())
    def batch(x: pd.Series) -> pd.Series:
        return pd.Series(_in_batches(x.tolist(), f), dtype="Int64")

    return lambda c: batch(c.cast("binary"))


def _bytewise(kind: type, start: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Batch:
    """A hash that takes one byte after another; bytes are signed and keep their sign when widened."""

    def run(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = np.full(len(rows), start, kind)
        signed = rows.view(np.int8)
        for j in range(int(sizes.max(initial=0))):
            h = np.where(j < sizes, step(h, signed[:, j].astype(np.int64).astype(kind)), h)
        return h.view(np.int32 if kind is np.uint32 else np.int64)

    return run


def _fnv(bits: int, xor_first: bool) -> Batch:
    kind, start, prime = (np.uint32, FNV32_START, FNV32_PRIME) if bits == 32 else (np.uint64, FNV64_START, FNV64_PRIME)
    return _bytewise(kind, start, (lambda h, b: (h ^ b) * kind(prime)) if xor_first else (lambda h, b: h * kind(prime) ^ b))


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint32(k) | x >> np.uint32(32 - k)


def jenkins_32(rows: np.ndarray, sizes: np.ndarray, start: int = SEED) -> np.ndarray:
    """Bob Jenkins' lookup3 for bytes of any number, from SEED."""
    s = [np.uint32(LOOKUP3_START) + sizes.astype(np.uint32) + np.uint32(start)] * 3
    words, blocks = rows.view("<u4"), (sizes + 11) // 12
    for j in range(int(blocks.max(initial=0))):
        here, last = j < blocks, j == blocks - 1
        new = [np.where(here, x + words[:, 3 * j + i], x) for i, x in enumerate(s)]
        mixed = list(new)
        for x, y, k, z in LOOKUP3_MIX:
            mixed[x] = (mixed[x] - mixed[y]) ^ _rotated(mixed[y], k)
            mixed[y] = mixed[y] + mixed[z]
        ended = list(new)
        for x, y, k in LOOKUP3_END:
            ended[x] = (ended[x] ^ ended[y]) - _rotated(ended[y], k)
        s = [np.where(here, np.where(last, e, m), x) for e, m, x in zip(ended, mixed, s, strict=True)]
    return s[2].view(np.int32)


def jenkins_64(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bob Jenkins' lookup8, from SEED, the whole 64 bits."""
    s = [np.full(len(rows), x, np.uint64) for x in (SEED, SEED, GOLDEN64)]

    def mix(s: list[np.ndarray]) -> list[np.ndarray]:
        s = list(s)
        for i, k in enumerate(LOOKUP8_MIX):
            x, y, z = i % 3, (i + 1) % 3, (i + 2) % 3
            s[x] = s[x] - s[y] - s[z]
            s[x] = s[x] ^ (s[z] >> np.uint64(k) if k > 0 else s[z] << np.uint64(-k))
        return s

    words = np.pad(rows, ((0, 0), (0, 24))).view("<u8")
    whole = sizes // 24
    for j in range(int(whole.max(initial=0))):
        mixed = mix([x + words[:, 3 * j + i] for i, x in enumerate(s)])
        s = [np.where(j < whole, m, x) for m, x in zip(mixed, s, strict=True)]
    rest = [words[np.arange(len(rows)), 3 * whole + i] for i in range(3)]
    # the lowest byte of the third word is kept for the length
    return mix([s[0] + rest[0], s[1] + rest[1], s[2] + sizes.astype(np.uint64) + (rest[2] << np.uint64(8))])[2].view(np.int64)


def _murmur(kind: type, m: int, seed: Callable[[np.ndarray], np.ndarray], shift: int, end: tuple[int, int], xor_last: bool) -> Batch:
    width = np.dtype(kind).itemsize

    def run(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h, by, words = seed(sizes), kind(m), np.pad(rows, ((0, 0), (0, 24))).view(f"<u{width}")
        whole = sizes // width
        for j in range(int(whole.max(initial=0))):
            k = words[:, j] * by
            k = (k ^ k >> kind(shift)) * by
            h = np.where(j < whole, (h * by) ^ k if xor_last else (h ^ k) * by, h)
        h = np.where(sizes % width > 0, (h ^ words[np.arange(len(rows)), whole]) * by, h)
        h = (h ^ h >> kind(end[0])) * by
        return (h ^ h >> kind(end[1])).view(np.int32 if width == 4 else np.int64)

    return run


#: Austin Appleby's MurmurHash2 and MurmurHash64A, from SEED.
murmur_32 = _murmur(np.uint32, MURMUR32, lambda n: np.uint32(SEED) ^ n.astype(np.uint32), 24, (13, 15), True)
murmur_64 = _murmur(np.uint64, MURMUR64, lambda n: np.uint64(SEED) ^ n.astype(np.uint64) * np.uint64(MURMUR64), 47, (47, 47), False)


HASHES = {
    "crc32": lambda c: F.crc32(c.cast("binary")),
    "md5": lambda c: F.md5(c.cast("binary")),
    "sha1": lambda c: F.sha1(c.cast("binary")),
    # the first four bytes of SHA-1 as a number
    "pure_sha1": lambda c: F.conv(F.substring(F.sha1(c.cast("binary")), 1, 8), 16, 10).cast("long"),
    "murmur3_32": lambda c: F.hash(c),
    "xxhash64": lambda c: F.xxhash64(c),
    "fnv1_32": _column(_fnv(32, False)),
    "fnv1a_32": _column(_fnv(32, True)),
    "fnv1_64": _column(_fnv(64, False)),
    "fnv1a_64": _column(_fnv(64, True)),
    # of text in ASCII what the runtime of the JVM gives a string
    "native": _column(_bytewise(np.uint32, 0, lambda h, b: h * np.uint32(31) + b)),
    "jenkins_32": _column(jenkins_32),
    "jenkins_64": _column(jenkins_64),
    "murmur_32": _column(murmur_32),
    "murmur_64": _column(murmur_64),
}


def hash_column(name: str, c: str | Column) -> Column:
    """A hash by name, in any letter case. The first six run in the JVM, the others as array operations on Arrow batches.

    Numbers are signed; of text, the UTF-8 bytes are hashed.
    """
    if name.lower() not in HASHES:
        raise ValueError(f"unknown hash {name}; there are {', '.join(sorted(HASHES))}")
    return HASHES[name.lower()](F.col(c) if isinstance(c, str) else c)


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def next_power_of_two(n: int) -> int:
    """The least power of two that is at least n."""
    return 1 if n < 1 else 1 << (n - 1).bit_length()


def shift_of(n: int) -> int:
    """The exponent of a power of two."""
    if not is_power_of_two(n):
        raise ValueError(f"{n} is no power of two")
    return n.bit_length() - 1


def fold_bucket(h: str | Column, buckets: int) -> Column:
    """One of 2^n buckets: the hash's upper part folded onto its lower n bits."""
    c = F.col(h) if isinstance(h, str) else h
    return F.shiftright(c, shift_of(buckets)).bitwiseXOR(c).bitwiseAND(F.lit(buckets - 1))


def load_balance(counts: np.ndarray) -> float:
    """Standard deviation (of the sample) over mean, in percent; 0 for fewer than two counts or none counted."""
    return float(np.std(counts, ddof=1) / np.mean(counts) * 100) if len(counts) > 1 and np.mean(counts) else 0.0
