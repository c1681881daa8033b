"""Random rows made where they are used."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def uniform(spark: SparkSession, size: int, dim: int = 1, seed: int = 0) -> DataFrame:
    """id, features: points of dim numbers, uniform in [0, 1)."""
    return spark.range(size).withColumn("features", F.array(*[F.rand(seed + i) for i in range(dim)]))


def gaussian(spark: SparkSession, size: int, centres: list[list[float]], spread: float = 1.0, seed: int = 0) -> DataFrame:
    """id, centre, features: normal points around centres taken in turn."""
    which = F.pmod(F.col("id"), F.lit(len(centres))).cast("int")
    places = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    noise = F.array(*[F.randn(seed + i) * spread for i in range(len(centres[0]))])
    rows = spark.range(size).withColumn("centre", which).withColumn("__noise", noise)
    return rows.select("id", "centre", F.zip_with(places[F.col("centre")], "__noise", lambda a, b: a + b).alias("features"))


@lru_cache(maxsize=8)
def _cumulated(alpha: float, n: int) -> np.ndarray:
    p = np.arange(1, n + 1, dtype=np.float64) ** -alpha
    return np.cumsum(p) / p.sum()


def zipf(spark: SparkSession, size: int, alpha: float, n: int, dim: int = 1, seed: int = 0) -> DataFrame:
    """id, features: numbers from 1 to n, k with a probability in proportion to k ** -alpha."""

    @F.pandas_udf(T.DoubleType())
    def ranked(u: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(_cumulated(alpha, n), u.to_numpy(), side="right") + 1, n).astype(np.float64))

    cols = [f"__u{i}" for i in range(dim)]
    rows = spark.range(size).select("id", *[F.rand(seed + i).alias(c) for i, c in enumerate(cols)])
    return rows.select("id", F.array(*[ranked(c) for c in cols]).alias("features"))
