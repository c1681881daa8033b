"""Key-aware fragmentation: a row is stored by its primary key, by each foreign key it holds, and wherever a row
that refers to it lives. The bitmap _hidden says which of these reasons put a copy in its shard, so every join along
a foreign key is local and every row can still be counted once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragsql.operators.catalog import HIDDEN, KEPT, SHARD, Catalog, TableSpec
from fragsql.functions.hashes import is_power_of_two
from fragsql.runtime import bounded_broadcast, stage


class Variant(Enum):
    """How the rows of a referenced table meet the index of the foreign keys that refer to them.

    The fragments are the same. normal: as the planner chooses. dist: the index is hashed in every task of a shuffle
    join. distmm: the index is broadcast, if it is small enough. grace: both sides are cut into buckets by key, sorted
    and merged, so that neither has to fit in memory. pgrace: the buckets are hashed instead of sorted. mpgrace: as
    pgrace, from several inputs of a table.
    """

    NORMAL = "normal"
    DISTRIBUTED = "dist"
    IN_MEMORY = "distmm"
    GRACE = "grace"
    PARALLEL_GRACE = "pgrace"
    MULTI_GRACE = "mpgrace"

    @classmethod
    def of(cls, name: str | Variant) -> Variant:
        """By name in any letter case; `distributed` is dist."""
        if isinstance(name, cls):
            return name
        lower = name.lower()
        return cls("dist" if lower == "distributed" else lower)


def route(keys: Sequence[str | Column], shards: int, by: str = "xxhash64") -> Column:
    """The shard of a key; null if a part of the key is null.

    by: xxhash64, or sha1: the first eight hex digits of the parts joined with |, as other programs can compute them.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    some = cols[0].isNull()
    for c in cols[1:]:
        some |= c.isNull()
    # text first, so that keys of different integer types meet in the same shard
    texts = [c.cast("string") for c in cols]
    if by == "xxhash64":
        number = F.xxhash64(*texts)
    elif by == "sha1":
        number = F.conv(F.substring(F.sha1(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long")
    else:
        raise ValueError(f"no placement by {by}")
    return F.when(~some, F.pmod(number, F.lit(shards)).cast("int"))


def plain_hash(df: DataFrame, keys: Sequence[str], shards: int, by: str = "xxhash64") -> DataFrame:
    """One copy of every row, in the shard of its key (0 if the key is null)."""
    return df.withColumn(SHARD, F.coalesce(route(keys, shards, by), F.lit(0)))


def _merged(places: Column) -> Column:
    """One (shard, bits) for each shard, its bits or-ed; places without shard are dropped."""
    here = F.filter(places, lambda p: p[SHARD].isNotNull())
    shards = F.array_distinct(F.transform(here, lambda p: p[SHARD]))
    return F.transform(
        shards,
        lambda s: F.struct(
            s.alias(SHARD),
            F.aggregate(F.filter(here, lambda p: p[SHARD] == s), F.lit(0), lambda a, p: a.bitwiseOR(p[HIDDEN])).alias(HIDDEN),
        ),
    )


_PLACES = f"array<struct<{SHARD}:int,{HIDDEN}:int>>"


def _index(copies: DataFrame, cols: Sequence[str], names: Sequence[str], out: str, bit: int | None = None) -> DataFrame:
    """For each key that rows of `copies` refer to, a map from the shards in which such rows live to their bits or the given one."""
    each = copies.groupBy(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)], SHARD).agg((F.bit_or(HIDDEN) if bit is None else F.lit(bit)).alias(HIDDEN))
    # no more entries than there are shards
    return each.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct(F.col(SHARD), F.col(HIDDEN)))).alias(out))


def _joined(df: DataFrame, index: DataFrame, names: Sequence[str], pk: Sequence[str], variant: Variant, buckets: int) -> DataFrame:
    on = F.lit(True)
    for n, k in zip(names, pk, strict=True):
        on &= F.col(n) == F.col(k)
    if variant is Variant.DISTRIBUTED:
        index = index.hint("shuffle_hash")
    elif variant is Variant.IN_MEMORY:
        index = bounded_broadcast(stage(index, "index"))
    elif variant is not Variant.NORMAL:
        df, index = df.repartition(buckets, *pk), index.repartition(buckets, *names).hint("merge" if variant is Variant.GRACE else "shuffle_hash")
    return df.join(index, on, "left").drop(*names)


def fragment(
    df: DataFrame | Sequence[DataFrame],
    spec: TableSpec,
    catalog: Catalog,
    shards: int,
    loaded: Mapping[str, DataFrame] | None = None,
    by: str = "xxhash64",
    variant: str | Variant = Variant.NORMAL,
    buckets: int = 128,
) -> DataFrame:
    """df with _shard and _hidden, a row for every shard that a row of df belongs to.

    Reasons: its primary key (bit of its own table), each foreign key it holds (bit of the referenced table), and
    each shard in which a row that refers to it lives (the bits of that row there). For the last, `loaded` holds the
    fragments of the referencing tables, which therefore come first (Catalog.load_order). A table that refers to
    itself is placed by its keys first and then joined with its own copies until no row comes to a new shard, once
    for each level of the hierarchy.

    The copies of a row are found within the row, without a shuffle; a referenced table is joined once with the
    shards of its referencing rows, at most one entry per key and shard, in the way that `variant` says (buckets must
    be a power of two). Several inputs are taken together by column name. A row whose keys are all null goes to
    shard 0 with its table's bit. Repeated rows stay repeated. An empty df gives no rows.
    """
    variant = Variant.of(variant)
    if not is_power_of_two(buckets):
        raise ValueError("buckets must be a power of two")
    if not isinstance(df, DataFrame):
        df = reduce(DataFrame.unionByName, df)
    at = [F.coalesce(route(spec.pk, shards, by), F.lit(0)), *[route(cols, shards, by) for cols, _ in spec.fks]]
    bits = [catalog.bit(spec.name), *[catalog.key_bit(spec.name, to) for _, to in spec.fks]]
    own = [f"__s{i}" for i in range(len(at))]
    out, maps, itself = df.withColumns(dict(zip(own, at, strict=True))), [], []
    for i, (other, cols) in enumerate(catalog.referencing(spec.name)):
        if other.name == spec.name:
            itself.append(cols)
            continue
        if not loaded or other.name not in loaded:
            raise ValueError(f"{other.name} refers to {spec.name} and must be loaded first")
        names = [f"__k{i}_{j}" for j in range(len(cols))]
        out = _joined(out, _index(loaded[other.name], cols, names, f"__m{i}"), names, spec.pk, variant, buckets)
        maps.append(f"__m{i}")
    if itself:
        return _levels(out, df.columns, dict(zip(own, bits, strict=True)), maps, itself, spec, catalog, variant, buckets)
    # no function of Python's and no lambda: small code, which the JVM compiles
    none = F.array().cast("array<int>")
    every = F.array_distinct(F.concat(F.array(*[F.col(n) for n in own]), *[F.coalesce(F.map_keys(m), none) for m in maps]))
    out = out.withColumn("__at", F.explode(every)).where(F.col("__at").isNotNull())
    why = [F.when(F.col(n) == F.col("__at"), F.lit(b)).otherwise(F.lit(0)) for n, b in zip(own, bits, strict=True)]
    why += [F.coalesce(F.col(m)[F.col("__at")], F.lit(0)) for m in maps]
    return out.select(*df.columns, F.col("__at").alias(SHARD), reduce(Column.bitwiseOR, why).alias(HIDDEN))


def _levels(out: DataFrame, columns: list[str], own: dict[str, int], maps: list[str], itself: list, spec: TableSpec, catalog: Catalog, variant: Variant, buckets: int) -> DataFrame:
    """A table that refers to itself: rows with all their places, joined with their own copies until none is new."""
    none = F.array().cast(_PLACES)
    lists = [F.array(*[F.struct(F.col(n).alias(SHARD), F.lit(b).alias(HIDDEN)) for n, b in own.items()])]
    entries = lambda m: F.coalesce(F.map_entries(m).cast(_PLACES), none)
    copies = lambda at: at.withColumn("__at", F.explode("__all")).select(*columns, F.col(f"__at.{SHARD}").alias(SHARD), F.col(f"__at.{HIDDEN}").alias(HIDDEN))
    out = out.select(*columns, F.concat(*lists, *[entries(m) for m in maps]).alias("__every"))
    size = None
    while True:  # ends, as a row has no more copies than there are shards, and no more bits than there are tables
        out = stage(out.select(*columns, _merged(F.col("__every")).alias("__all")), "levels")
        before, size = size, out.agg(F.sum(F.size("__all")), F.sum(F.aggregate("__all", F.lit(0), lambda a, p: a + F.bit_count(p[HIDDEN])))).first()
        if before == size:
            return copies(out)
        here, more = copies(out), []
        for j, cols in enumerate(itself):
            names = [f"__k{j}_{x}" for x in range(len(cols))]
            out = _joined(out, _index(here, cols, names, f"__self{j}", catalog.key_bit(spec.name, spec.name, KEPT)), names, spec.pk, variant, buckets)
            more.append(entries(f"__self{j}"))
        out = out.select(*columns, F.concat("__all", *more).alias("__every"))


def fragment_all(tables: Mapping[str, DataFrame], catalog: Catalog, shards: int, by: str = "xxhash64", variant: str | Variant = Variant.NORMAL) -> dict[str, DataFrame]:
    """Fragments of every registered table, each staged once, a directory for each shard, before the tables it refers to are placed."""
    out: dict[str, DataFrame] = {}
    for name in catalog.load_order():
        out[name] = stage(fragment(tables[name], catalog.spec(name), catalog, shards, out, by, variant), f"fragment-{name}", SHARD)
    return out


def save_fragments(df: DataFrame, path: str, mode: str = "errorifexists", expected: int | None = None) -> None:
    """Write fragments in one directory per shard, so that a query of a shard reads that directory alone.

    If the rows written aren't as many as expected, that is an error.
    """
    df.hint("rebalance", SHARD).write.mode(mode).partitionBy(SHARD).parquet(path)
    if expected is not None and (written := df.sparkSession.read.parquet(path).count()) != expected:
        raise ValueError(f"{written} rows were written to {path}, {expected} were expected")


def family(df: DataFrame, bits: int) -> DataFrame:
    """The copies placed for all of these reasons: for one bit, every logical row exactly once."""
    return df.where(F.col(HIDDEN).bitwiseAND(F.lit(bits)) == bits)


def any_family(df: DataFrame, bits: int) -> DataFrame:
    """The copies placed for any of these reasons."""
    return df.where(F.col(HIDDEN).bitwiseAND(F.lit(bits)) != 0)


def multi_key_copies(df: DataFrame, keys: Sequence[Sequence[str]], shards: int, by: str = "xxhash64") -> DataFrame:
    """One copy of a row for each different shard that its keys lead to; null keys lead nowhere."""
    return df.withColumn(SHARD, F.explode(F.array_distinct(F.array_compact(F.array(*[route(k, shards, by) for k in keys])))))


def overlap_ratio(df: DataFrame, keys: Sequence[Sequence[str]], shards: int, by: str = "xxhash64") -> DataFrame:
    """n_keys, n_copies, overlap: the share of key placements that another key of the row made needless."""
    at = F.array_compact(F.array(*[route(k, shards, by) for k in keys]))
    sums = df.select(F.size(at).alias("k"), F.size(F.array_distinct(at)).alias("c")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_keys"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_copies"))
    return sums.withColumn("overlap", F.coalesce(F.try_divide(F.col("n_keys") - F.col("n_copies"), F.col("n_keys")), F.lit(0.0)))


def shard_stats(df: DataFrame, shards: int) -> DataFrame:
    """Rows per shard, empty shards included: total, most, least, mean (truncated), stddev of the sample, and its percentage of the mean."""
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias(SHARD))
    sizes = every.join(df.groupBy(SHARD).agg(F.count(F.lit(1)).alias("n")), SHARD, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    stats = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"), F.floor(F.avg("n")).alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("stddev"))
    return stats.withColumn("percent", F.coalesce(F.try_divide(F.col("stddev") * 100, "mean"), F.lit(0.0)))


def missing_keys(df: DataFrame, fk: Sequence[str], referenced: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Different foreign keys of df, named as pk, that no row of `referenced` has. Keys with a null refer to nothing."""
    keys = df.select(*[F.col(f).alias(p) for f, p in zip(fk, pk, strict=True)]).dropna().distinct()
    return keys.join(referenced.select(*pk), list(pk), "left_anti")


def complete_references(target: DataFrame, source: DataFrame, pk: Sequence[str], missing: DataFrame) -> DataFrame:
    """Rows of source whose key is missing in target, different ones, without those target has already."""
    return source.join(missing.select(*pk), list(pk), "left_semi").select(*target.columns).subtract(target)
