"""Queries of the problems 1, 3, 4, 7, 8 and 9, with their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragsql.llm import distinct, mixing, packing, repetition
from fragsql.llm.frequent import frequent_items
from fragsql.llm.topn import top_n_per_group
from fragsql.runtime import bounded_broadcast, day_number, day_string, stage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # at most 500 values can each hold 1/500
    return frequent_items(table(spark, d, "access_log"), "url", k=500, min_share=Fraction(1, 500)).select("url")


def p1_top100(spark: SparkSession, d: str) -> DataFrame:
    return frequent_items(table(spark, d, "access_log"), "url", k=100)


def _referrer_counts(spark: SparkSession, d: str) -> DataFrame:
    access = table(spark, d, "access_log").where("referrer is not null and referrer <> ''")
    # read twice by the operator
    return stage(access.groupBy("url", "referrer").agg(F.count(F.lit(1)).alias("n")), "counts")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(_referrer_counts(spark, d), ["url"], "n", ["referrer"], 3, min_items=4).select("url", "referrer")


def p3_top10(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(_referrer_counts(spark, d), ["url"], "n", ["referrer"], 10)


def _values(spark: SparkSession, d: str) -> DataFrame:
    """day, node, field, value of every url and referrer that is neither null nor empty."""
    access = table(spark, d, "access_log").select(day_number("time").alias("day"), "node", "url", "referrer")
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("url", "referrer")]))
    return access.select("day", "node", pair.alias("v")).select("day", "node", "v.field", "v.value").where(F.col("value") != "")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["day", "node", "field"]
    values = _values(spark, d).where("day is not null and node is not null")
    sketched = distinct.estimate(distinct.build(values, keys, "value"), keys, sigmas=6)
    likely = stage(sketched.where((F.col("records") >= 200) & (F.col("high") * 100 >= F.col("records") * 85)).select(*keys), "likely")
    # the sketches leave few groups, and those are counted exactly
    exact = values.join(bounded_broadcast(likely), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("u"))
    return exact.where(F.col("u") * 100 >= F.col("n") * 85).select(day_string("day").alias("day"), "node", "field")


def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Estimates per day and node, per day and per node, all from one table of sketches."""
    fine = stage(distinct.build(_values(spark, d), ["day", "node", "field"], "value"), "sketches")
    none: dict[str, Column] = {"day": F.lit(None).cast("int"), "node": F.lit(None).cast("string")}
    levels = [("day, node", ["day", "node"]), ("day", ["day"]), ("node", ["node"])]
    out = None
    for level, keys in levels:
        sketch = fine if len(keys) == 2 else distinct.merge(fine, [*keys, "field"])
        got = distinct.estimate(sketch, [*keys, "field"]).withColumns({k: c for k, c in none.items() if k not in keys} | {"level": F.lit(level)})
        out = got if out is None else out.unionByName(got)
    return out.select("level", day_string("day").alias("day"), "node", "field", "records", "estimate", "error", "low", "high")


def p4_within(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of different values of each day and node, of each day and of each node, and whether it lies within six errors of the estimate."""
    values = stage(_values(spark, d), "values")
    fine = stage(distinct.build(values, ["day", "node", "field"], "value"), "sketches")
    out = None
    for keys in (["day", "node", "field"], ["day", "field"], ["node", "field"]):
        sketch = distinct.estimate(fine if len(keys) == 3 else distinct.merge(fine, keys), keys, sigmas=6)
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"k{i}"))
        exact = values.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count_distinct("value").alias("exact"))
        got = sketch.join(exact, same).select(*[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("day", "node", "field")], "records", "exact", F.col("exact").between(F.col("low") - 1, F.col("high") + 1).alias("within"))
        out = got if out is None else out.unionByName(got)
    return out.select(day_string(F.col("day").cast("int")).alias("day"), "node", "field", "records", "exact", "within")


def p7_method(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container. p7_found's rows don't depend on how containers are filled: see the README."""
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_method(spark, d).where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_method(spark, d))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: documents, those lost or split though they fit, containers overfull, and whether no two containers but a pool's last fit into one."""
    packed = stage(p7_method(spark, d), "packed")
    sizes = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.max("n_pieces").alias("pieces"), F.countDistinct("piece").alias("there"))
    of = sizes.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("there") != F.col("pieces")).cast("bigint")).alias("lost"), F.sum(((F.col("size") <= 2048) & (F.col("pieces") > 1)).cast("bigint")).alias("split"))
    report = packing.fill_report(packed).agg(F.sum((F.col("slack") < 0).cast("bigint")).alias("overfull"), (F.sum("slack") * 20 <= F.sum("used")).alias("tight"))
    return of.crossJoin(report)  # one row each


def _prepared(spark: SparkSession, d: str, size: str | None = None) -> mixing.Prepared:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.prepare(docs, table(spark, d, "mix_target"), "doc_id", "text", size=size)


def p8_method(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself. p8_found's rows don't depend on the draw: see the README."""
    return mixing.mixture(_prepared(spark, d)).select("place", "record.doc_id", "copy", "source_key", "record.text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(_prepared(spark, d)).where(~F.col("reachable")).select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(_prepared(spark, d))


def p8_reachable_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest mixture in which every source has its share."""
    return mixing.share_report(_prepared(spark, d, mixing.REACHABLE))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mixture: for each source of the target, its records used too often and copies of others' records."""
    target = table(spark, d, "mix_target").select(mixing.source_key("source").alias("source"), "max_repeats")
    uses = p8_method(spark, d).groupBy("source_key", "doc_id").agg(F.max("copy").alias("copies"), F.count(F.lit(1)).alias("n"))
    wrong = (F.col("copies") > F.col("max_repeats")) | (F.col("copies") != F.col("n"))
    of = uses.join(target, F.col("source") == F.col("source_key"), "full")
    return of.groupBy(F.coalesce("source", F.lit("none of the target")).alias("source")).agg(F.sum(F.coalesce(wrong, F.lit(False)).cast("bigint")).alias("wrong"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"), "doc_id", "text").where("excessive").select("doc_id")


def p9_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "n_words", "n_repeated", "share")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_top100, p3_found, p3_top10, p4_found, p4_distinct, p4_within, p7_method, p7_found, p7_containers, p7_kept,
        p8_method, p8_found, p8_shares, p8_reachable_shares, p8_kept, p9_found, p9_repetition,
    )
}

_P3 = """
with r as (select url, referrer, count(*) as n from access_log where referrer <> '' group by 1, 2),
t as (select *, row_number() over (partition by url order by n desc, referrer) as rank, count(*) over (partition by url) as k from r)
"""

_P9 = """
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as ws from documents),
g as (select doc_id, i, list_aggregate(ws[i:i + 5], 'string_agg', ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 4)) as i from w)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id, gram order by i) as k from g) where k > 1),
cover as (select doc_id, count(distinct i + j) as n_repeated from late, range(6) t(j) group by 1),
result as (select w.doc_id, len(ws) as n_words, coalesce(n_repeated, 0) as n_repeated from w left join cover on w.doc_id = cover.doc_id)
"""

SQL = {
    "p1_found": "select url from access_log group by 1 having count(*) * 500 >= (select count(*) from access_log)",
    "p1_top100": """
      select url, count(*) as n, cast(row_number() over (order by count(*) desc, url) as integer) as rank from access_log group by 1
      order by rank limit 100""",
    "p3_found": _P3 + "select url, referrer from t where k >= 4 and rank <= 3",
    "p3_top10": _P3 + "select url, referrer, n, cast(rank as integer) as rank from t where rank <= 10",
    "p4_found": """
      with v as (
        select cast(date '1970-01-01' + cast(floor(time / 86400000.0) as integer) as varchar) as day, node, 'url' as field, url as value from access_log where url <> ''
        union all
        select cast(date '1970-01-01' + cast(floor(time / 86400000.0) as integer) as varchar), node, 'referrer', referrer from access_log where referrer <> '')
      select day, node, field from v where node is not null and day is not null group by 1, 2, 3
      having count(*) >= 200 and count(distinct value) * 100 >= count(*) * 85""",
    "p4_within": """
      with v as (
        select cast(floor(time / 86400000.0) as integer) as d, node, 'url' as field, url as value from access_log where url <> ''
        union all select cast(floor(time / 86400000.0) as integer), node, 'referrer', referrer from access_log where referrer <> ''),
      g as (
        select d, node, field, count(*) as records, count(distinct value) as exact from v group by 1, 2, 3
        union all select d, null, field, count(*), count(distinct value) from v group by 1, 2, 3
        union all select null, node, field, count(*), count(distinct value) from v group by 1, 2, 3)
      select cast(date '1970-01-01' + d as varchar) as day, node, field, records, exact, true as within from g""",
    "p7_kept": "select count(distinct doc_id) as documents, cast(0 as bigint) as lost, cast(0 as bigint) as split, cast(0 as bigint) as overfull, true as tight from documents",
    "p8_kept": "select distinct lower(trim(source)) as source, cast(0 as bigint) as wrong from mix_target",
    "p9_found": _P9 + "select doc_id from result where n_repeated > 0 and n_repeated * 10 >= n_words * 4",
    "p9_repetition": _P9 + "select doc_id, n_words, n_repeated, n_repeated / greatest(n_words, 1)::double as share from result",
}
