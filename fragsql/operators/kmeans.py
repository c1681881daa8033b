"""k-means: distances and sums as array operations on Arrow batches; no point moves between tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fragsql.runtime import stage


def squared_distance(features: str | Column, centroid: Sequence[float]) -> Column:
    c = F.array(*[F.lit(float(x)) for x in centroid])
    diff = F.zip_with(F.col(features) if isinstance(features, str) else features, c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(diff, F.lit(0.0), lambda a, x: a + x)


def _matrix(lists: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold d numbers, and these as a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), d), False).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists.filter(pa.array(right)))
    gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(1)
    points = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)[~gaps]
    right[np.flatnonzero(right)[gaps]] = False
    return right, points


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The place of the nearest centroid, of equally near ones the lowest, a few thousand points at a time."""
    rows = max(1, (1 << 21) // max(1, centroids.size))
    parts = [((points[i : i + rows, None, :] - centroids[None]) ** 2).sum(-1).argmin(1) for i in range(0, len(points), rows)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def assign(df: DataFrame, features: str, centroids: Sequence[Sequence[float]], label: str = "label") -> DataFrame:
    """The nearest centroid's place (from 0) for each row, of equally near ones the lowest.

    Null features, those with a null among them and those of another length than the centroids' give null. Distances
    are array operations on Arrow batches; the plan is as small for thousands of centroids as for two.
    """
    c = np.array(centroids, np.float64)

    @F.pandas_udf("int")
    def nearest(batch: pd.Series) -> pd.Series:
        lists = pa.array(batch, pa.list_(pa.float64()))
        right, points = _matrix(lists, c.shape[1])
        out = np.full(len(right), -1)
        out[right] = _nearest(points, c)
        return pd.Series(out).where(right).astype("Int32")

    return df.withColumn(label, nearest(F.col(features).cast("array<double>")))


def _sums(df: DataFrame, features: str, label: str | None, centroids: np.ndarray | None) -> DataFrame:
    """label, p, s, c, n: each task's sums, numbers and rows for every label and place, by a column or by the nearest centroid."""
    kind = dict(df.dtypes)[label] if label else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[Any, list[np.ndarray]] = {}
        for batch in batches:
            lists = batch.column(0)
            if centroids is None:
                keys = batch.column(1).dictionary_encode()
                at, names = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False), keys.dictionary.to_pylist()
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = pc.list_flatten(lists)
                there = flat.is_valid().to_numpy(zero_copy_only=False)
                x = np.where(there, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
            else:
                right, points = _matrix(lists, centroids.shape[1])
                at, names = _nearest(points, centroids), list(range(len(centroids)))
                sizes, x = np.full(len(points), centroids.shape[1]), points.ravel()
                there = np.ones(len(x), bool)
            width = int(sizes.max(initial=0))
            if not width or not names:
                continue
            owner, place = np.repeat(at, sizes), np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = (owner >= 0) & there
            cell, size = owner[kept] * width + place[kept], len(names) * width
            s, c = np.bincount(cell, x[kept], size).reshape(-1, width), np.bincount(cell, minlength=size).reshape(-1, width)
            for i in np.flatnonzero(c.any(1)):
                old = totals.get(names[i])
                new = [s[i], c[i]]
                if old is not None:
                    longer = max(width, len(old[0]))
                    new = [np.pad(a, (0, longer - len(a))) + np.pad(b, (0, longer - len(b))) for a, b in zip(old, new, strict=True)]
                totals[names[i]] = new
        rows = [(k, p, float(s[p]), int(c[p])) for k, (s, c) in totals.items() for p in np.flatnonzero(c)]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], label_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], names=[name, "p", "s", "c"])

    name = label or "label"
    schema = T.StructType.fromDDL(f"`{name}` {kind}, p int, s double, c bigint")
    label_type = to_arrow_schema(schema).field(0).type
    source = df.select(F.col(features).cast("array<double>"), *([label] if label else []))
    return source.mapInArrow(run, schema)


def _means(sums: DataFrame, label: str) -> DataFrame:
    by_place = sums.groupBy(label, "p").agg((F.sum("s") / F.sum("c")).alias("m"), F.sum("c").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"])
    return by_place.groupBy(label).agg(F.max("n").alias("n"), in_order.alias("mean"))


def means(df: DataFrame, features: str, label: str) -> DataFrame:
    """label, n, mean: the element-wise mean of each label's features; null elements are left out, as are labels of null.

    Every task sums up its own rows; only sums by label and place move.
    """
    return _means(_sums(df, features, label, None), label)


def initial_labels(df: DataFrame, k: int, seed: int = 0, label: str = "label") -> DataFrame:
    """A random label for each row."""
    return df.withColumn(label, F.floor(F.rand(seed) * k).cast("int"))


def group_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _centroids(found: DataFrame, label: str, k: int, before: list[list[float]] | None) -> list[list[float]]:
    # k rows, whatever the number of points
    found = {r[label]: [float(x) for x in r["mean"]] for r in found.collect()}
    if before is None:
        before = [c for _, c in sorted(found.items())]
        before = [before[i % len(before)] for i in range(k)] if before else []
    return [found.get(i, before[i]) for i in range(len(before))]


class Fit(tuple):
    """(centroids, df with label, iterations), and converged: whether the centroids came to rest."""

    converged: bool

    def __new__(cls, centroids: list[list[float]], labelled: DataFrame, iterations: int, converged: bool) -> Fit:
        self = super().__new__(cls, (centroids, labelled, iterations))
        self.converged = converged
        return self


def fit(df: DataFrame, features: str, k: int, max_iterations: int | None = None, tolerance: float = 1e-9, seed: int = 0, start: Sequence[Sequence[float]] | None = None) -> Fit:
    """(centroids, df with label, iterations). Ends when the squared moves of all centroids sum to less than tolerance.

    With max_iterations it may end before that, which the result's converged tells.
    Starts from `start`, or from the means of random labels. A centroid that no point is nearest to stays where it
    is. Only the k centroids come to the driver. Without points there are no centroids and labels are null.
    """
    if start is None:
        centroids = _centroids(means(stage(initial_labels(df.where(F.col(features).isNotNull()).select(features), k, seed, "__l"), "start"), features, "__l"), "__l", k, None)
    else:
        centroids = [[float(x) for x in c] for c in start]
    if not centroids:
        return Fit([], df.withColumn("label", F.lit(None).cast("int")), 0, True)
    turn, converged = 0, False
    while not converged and (max_iterations is None or turn < max_iterations):
        turn += 1
        after = _centroids(_means(_sums(df, features, None, np.array(centroids)), "label"), "label", k, centroids)
        moved = sum((x - y) ** 2 for a, b in zip(after, centroids, strict=True) for x, y in zip(a, b, strict=True))
        centroids, converged = after, moved < tolerance
    return Fit(centroids, assign(df, features, centroids), turn, converged)


def sample(df: DataFrame, show: int, size: int, seed: int = 0) -> DataFrame:
    """Each row with probability min(1, show / size)."""
    return df.sample(False, min(1.0, show / size), seed) if size else df.limit(0)
