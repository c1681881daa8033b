"""Distinct counts from stochastic-averaging bit matrices, merged by bitwise union, estimated by maximum likelihood.

A value's 64-bit hash names a row of the matrix (its low bits) and a rank (trailing zeros of the rest, geometric).
A sketch is stored sparsely: one table row for each touched matrix row, with its bits and how many records fell in.
Rows of several sketches with the same matrix row merge by bit_or, so parts combine in any order and any grouping.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix. The relative standard error is at most 0.649 / sqrt(ROWS), about 1.0 %.
ROWS = 4096
#: Ranks from 0; hash bits beyond count as the last rank.
RANKS = 48


def build(df: DataFrame, groups: Sequence[str], value: str, rows: int = ROWS) -> DataFrame:
    """groups, cell (matrix row), bits, records: the sketch of each group.

    Null values are left out; null groups form groups of their own; the empty text is a value; repeated rows add to
    records alone. An empty df gives an empty sketch. Other columns are ignored, whatever their names.
    """
    if rows & (rows - 1) or not 2 <= rows <= 1 << 15:
        raise ValueError("rows must be a power of two from 2 to 32768")
    if {"cell", "bits", "records"} & set(groups):
        raise ValueError("groups can't be called cell, bits or records")
    shift = rows.bit_length() - 1
    h = F.xxhash64(value)
    rest = F.shiftrightunsigned(h, shift).bitwiseOR(F.lit(1 << (RANKS - 1)))
    lowest = rest.bitwiseAND(-rest)  # the lowest bit set is the rank, already as a bit
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, h.bitwiseAND(F.lit(rows - 1)).cast("int").alias("cell"))
        .agg(F.bit_or(lowest).alias("bits"), F.count(F.lit(1)).alias("records"))
    )


def merge(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sketch of coarser groups, or of several sketches put together by union."""
    return sketch.groupBy(*groups, "cell").agg(F.bit_or("bits").alias("bits"), F.sum("records").alias("records"))


def likelihood(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and standard error for each line of counts (how many matrix rows have the bit of each rank).

    With n values, rank k of a matrix row is set with probability 1 - exp(-n/rows * 2^-(k+1)), independently (as if
    n were Poisson). The likelihood has one maximum, where its slope, falling in n, is zero; it is found by bisection
    on log n. The variance is the inverse Fisher information, less n, the spread that a Poisson n would have had.
    """
    p = 0.5 ** (np.arange(RANKS) + 1.0)
    p[-1] *= 2  # the last rank stands for all beyond
    c = counts.astype(np.float64)
    some = c.sum(1) > 0
    low, high = np.full(len(c), -12.0), np.full(len(c), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        x = np.clip(np.exp(mid)[:, None] * p, 1e-300, 700)
        slope = (c * p / np.expm1(x)).sum(1) - ((rows - c) * p).sum(1)
        low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
    lam = np.exp((low + high) / 2)
    x = np.clip(lam[:, None] * p, 1e-300, 700)
    info = (p * p / np.expm1(x)).sum(1)
    n = lam * rows
    error = np.sqrt(np.maximum(rows / info - n, n / rows))
    return np.where(some, n, 0.0), np.where(some, error, 0.0)


def _solve(lists: pd.Series, rows: int) -> pd.DataFrame:
    sizes = lists.map(len).to_numpy()
    bits = np.concatenate([np.asarray(x, dtype="<u8") for x in lists]) if sizes.sum() else np.zeros(0, "<u8")
    counts = np.zeros((len(lists), RANKS), np.int64)
    for begin in range(0, len(lists), 256):  # bounds the unpacked matrix
        part = sizes[begin : begin + 256]
        at = sizes[:begin].sum()
        flat = np.unpackbits(bits[at : at + part.sum()].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :RANKS]
        if len(flat):
            owner = np.repeat(np.arange(len(part)), part)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts[begin + owner[starts]] = np.add.reduceat(flat.astype(np.int64), starts, axis=0)
    estimate, error = likelihood(counts, rows)
    return pd.DataFrame({"estimate": estimate, "error": error})


def estimate(sketch: DataFrame, groups: Sequence[str], rows: int = ROWS, sigmas: float = 3.0) -> DataFrame:
    """groups, records, estimate, error (standard), low, high (estimate -/+ sigmas errors) of each group.

    sketch holds each group's cells at most once (see merge). An empty sketch gives no rows. A group brings at most
    `rows` cells together, whatever the number of its values.
    """

    @F.pandas_udf("estimate double, error double")
    def solve(lists: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in lists:
            yield _solve(x, rows)

    per = sketch.groupBy(*groups).agg(F.sum("records").alias("records"), F.collect_list("bits").alias("__bits"))
    solved = per.select(*groups, "records", solve("__bits").alias("__s"))
    e, s = F.col("__s.estimate"), F.col("__s.error")
    return solved.select(*groups, "records", e.alias("estimate"), s.alias("error"), F.greatest(e - s * sigmas, F.lit(0.0)).alias("low"), (e + s * sigmas).alias("high"))
