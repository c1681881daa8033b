"""Mixtures of sources with target shares, by Poisson replication."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragsql.llm.tokens import VOCABULARY, token_count
from fragsql.runtime import bounded_broadcast, stage


class Prepared(NamedTuple):
    docs: DataFrame  # id, source_key, n_tokens, copies and record, a struct of all columns; read from the input itself
    plan: DataFrame  # a row for each source of the target
    sizes: DataFrame  # source_key, n_tokens, copies: staged, a few bytes a record


#: A size for prepare(): the largest at which every source can have its share.
REACHABLE = "reachable"


def source_key(source: str | Column) -> Column:
    """A source without blanks around it and in lower case."""
    return F.lower(F.btrim(F.col(source) if isinstance(source, str) else source, F.lit(" \t\r\n")))


def _poisson(means: np.ndarray, cap: int) -> np.ndarray:
    """P(X = 0), ... P(X = cap - 1) in a line for each mean."""
    if means.max() <= 700:
        steps = means[:, None] / np.maximum(np.arange(cap), 1)
        steps[:, 0] = np.exp(-means)
        return np.cumprod(steps, axis=1)
    with np.errstate(divide="ignore"):  # exp(-mean) would be 0
        steps = np.log(means)[:, None] - np.log(np.maximum(np.arange(cap), 1))
    steps[:, 0] = -means
    return np.exp(np.cumsum(steps, axis=1))


def copies_distributions(rates: np.ndarray, cap: int) -> np.ndarray:
    """P(X <= 0), ... P(X <= cap - 1) of the Poisson X for which min(X, cap) has the mean rate, in a line for each rate.

    A rate of 0 or less gives no copies, one of cap or more always cap of them.
    """
    rates = np.asarray(rates, np.float64)
    out = np.where(rates[:, None] >= cap, 0.0, np.ones((len(rates), max(cap, 0))))
    inner = np.flatnonzero((rates > 0) & (rates < cap))
    if cap < 1 or not len(inner):
        return out
    # at this mean, X falls short of the cap too seldom for any rate below it to lie higher
    low, high = np.zeros(len(inner)), np.full(len(inner), max(700.0, cap + 40 * cap**0.5))
    for _ in range(70):
        mid = (low + high) / 2
        mean = cap - ((cap - np.arange(cap)) * _poisson(mid, cap)).sum(axis=1)
        low, high = np.where(mean < rates[inner], mid, low), np.where(mean < rates[inner], high, mid)
    out[inner] = np.minimum(np.cumsum(_poisson(low, cap), axis=1), 1.0)
    return out


#: Factors of the rate that are tried so that the tokens drawn come close to the tokens wanted; the middle one is 1.
FACTORS = [1.04**k for k in range(-10, 11)]
#: Independent draws that each factor is tried with.
DRAWS = 4


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _distributions(rate: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([copies_distributions(np.array(FACTORS) * r if r < c else np.full(len(FACTORS), r), int(c)).tolist() for r, c in zip(rate, cap, strict=True)])


def uniform(*columns: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def prepare(
    df: DataFrame,
    target: DataFrame,
    id_: str,
    text: str,
    source: str = "source",
    share: str = "target_share",
    cap: str = "max_repeats",
    size: int | str | None = None,
    seed: int = 0,
    vocabulary: str = VOCABULARY,
) -> Prepared:
    """Measure df and decide how often each record is used.

    Only sizes are staged, not texts. A mixture of `size` tokens (default: all texts together; REACHABLE: as many of
    them as allow every source that has texts its share at its cap, so that shares come out as wanted) needs share * size tokens of a source, which has
    available tokens: each of its records is used rate = needed / available times on average, at most `cap` times.
    The number of uses is a Poisson number, inverted at a uniform number hashed from seed and id, cut at the cap; its
    mean is set so that the cut number has the mean rate. As few long records can carry a source far from its share,
    DRAWS draws are tried with FACTORS of the rate, in one pass over the sizes, and each source keeps the one whose
    tokens come closest to those wanted. A record gets the same number in every run.

    Sources are compared without blanks around them and in lower case. Records of other sources and those without
    source aren't used but count in the total. A null or empty text has 0 tokens, is no use and is left out of the
    mixture only if its draw says so, like any record. A null share or cap counts as 0; of repeated rows of a source
    in the target, the one with the largest share counts. Rows with the same id are used equally often. Empty tables
    give empty results. Columns of df come back in a struct, so that their names can't clash.
    """
    tokens = token_count(text, vocabulary).alias("n_tokens")
    sized = stage(df.select(F.col(id_).alias("id"), source_key(source).alias("source_key"), tokens), "sized")
    by_source = stage(sized.groupBy("source_key").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("records")), "sources")
    total = size if isinstance(size, int) else by_source.agg(F.sum("available")).first()[0] or 0
    wanted = target.where(F.col(source).isNotNull()).groupBy(source_key(source).alias("source")).agg(F.max(F.struct(F.coalesce(share, F.lit(0.0)).alias("s"), F.coalesce(cap, F.lit(0)).alias("c"))).alias("w"))
    wanted = wanted.join(by_source, F.col("source") == F.col("source_key"), "left")
    if size == REACHABLE:
        most = F.when((F.col("w.s") > 0) & (F.col("available") > 0), F.col("w.c") * F.col("available") / F.col("w.s"))
        total = min(by_source.agg(F.sum("available")).first()[0] or 0, wanted.agg(F.floor(F.min(most))).first()[0] or 0)
    plan = wanted.select(
        "source", F.col("w.s").alias("target_share"), F.col("w.c").alias("max_repeats"),
        F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("records", F.lit(0)).alias("records"),
        (F.col("w.s") * F.lit(total)).alias("wanted"),
    )
    most = F.col("max_repeats") * F.col("available")
    plan = plan.withColumns({"reachable": F.col("wanted") <= most, "rate": F.least(F.coalesce(F.try_divide("wanted", "available"), F.lit(0.0)), F.col("max_repeats").cast("double"))})
    plan = stage(plan.withColumn("cdfs", _distributions("rate", "max_repeats")), "plan")
    us = F.array(*[uniform("id", seed=seed + 1_000_003 * d) for d in range(DRAWS)])
    uses = lambda u, cdf: F.coalesce(F.size(F.filter(cdf, lambda c: u > c)), F.lit(0))
    every = F.flatten(F.transform("us", lambda u: F.transform("cdfs", lambda cdf: uses(u, cdf))))
    tried = (
        sized.join(bounded_broadcast(plan.select(F.col("source").alias("__s"), "cdfs")), F.col("source_key") == F.col("__s"))
        .select("__s", "n_tokens", "cdfs", us.alias("us"))
        .select("__s", "n_tokens", every.alias("uses"))
        .groupBy("__s")
        .agg(F.expr("array(" + ", ".join(f"sum(n_tokens * uses[{j}])" for j in range(DRAWS * len(FACTORS))) + ")").alias("drawn"))
    )
    gap = F.transform("drawn", lambda x, i: F.struct(F.abs(x - F.col("wanted")).alias("gap"), F.abs(i % len(FACTORS) - F.lit(len(FACTORS) // 2)).alias("far"), i.alias("i")))
    plan = plan.join(tried, F.col("source") == F.col("__s"), "left").withColumn("chosen", F.coalesce(F.array_min(gap)["i"], F.lit(len(FACTORS) // 2)))
    plan = plan.withColumns({"cdf": F.col("cdfs")[F.col("chosen") % len(FACTORS)], "draw": F.floor(F.col("chosen") / len(FACTORS)).cast("int")}).drop("__s", "drawn", "cdfs", "chosen")
    plan = stage(plan, "chosen")
    cdfs = bounded_broadcast(plan.select(F.col("source").alias("__s"), "cdf", "draw"))
    drawn = lambda rows: rows.join(cdfs, F.col("source_key") == F.col("__s"), "left").withColumn("copies", uses(us[F.col("draw")], F.col("cdf"))).drop("cdf", "draw", "__s")
    docs = drawn(df.select(F.col(id_).alias("id"), source_key(source).alias("source_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")))
    docs = docs.withColumn("n_tokens", token_count(F.col("record")[text], vocabulary))
    return Prepared(docs, plan, drawn(sized).drop("id"))


def mixture(prepared: Prepared, seed: int = 0) -> DataFrame:
    """The records, each as often as it is used (copy, from 1), in a global random order given by the column place.

    n_tokens is measured again, for the records used and only if it is asked for.
    """
    out = prepared.docs.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.withColumn("place", F.xxhash64(F.lit(seed + 1), "id", "copy")).orderBy("place", "id", "copy")


def share_report(prepared: Prepared) -> DataFrame:
    """A row for each source of the target: tokens available and wanted, whether they can be reached, tokens and share of all tokens used, and share_of_size, what was used against the size of the whole mixture wanted."""
    used = prepared.sizes.where("copies > 0").groupBy("source_key").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used"), F.sum("copies").alias("uses"))
    joined = prepared.plan.join(used, F.col("source") == F.col("source_key"), "left").drop("source_key", "cdf", "draw")
    joined = stage(joined.withColumns({"used": F.coalesce("used", F.lit(0)), "uses": F.coalesce("uses", F.lit(0))}), "report")
    all_used = joined.agg(F.sum("used")).first()[0] or 0
    shares = {"actual_share": F.col("used") / F.lit(float(all_used)) if all_used else F.lit(0.0)}
    return joined.withColumns(shares | {"share_of_size": F.coalesce(F.try_divide(F.col("used") * F.col("target_share"), "wanted"), F.lit(0.0))})
