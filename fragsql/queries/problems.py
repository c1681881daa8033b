"""Queries of the general problems 2, 5 and 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragsql.operators.eager_join import eager_join_aggregate, state
from fragsql.operators.rolling import rolling_totals
from fragsql.operators.spikes import measurement_faults, phase_space_faults
from fragsql.runtime import day_number, day_string, table

METRIC_FIELDS = ("last_cpu_load", "last_io_wait")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    access = table(spark, d, "access_log").where("node is not null")
    stored = table(spark, d, "pageview")
    both = eager_join_aggregate(access, stored, ["url", "node"], {"seen": ("distinct", "time")}, {"stored": ("max", "pageview")}, how="right")
    return both.where(~F.col("stored").eqNullSafe(F.coalesce("seen", F.lit(0)))).select("url", "node")


def p2_accesses(spark: SparkSession, d: str) -> DataFrame:
    """Accesses per url and node: rows, and different times."""
    access = table(spark, d, "access_log").where("node is not null")
    return state(access, ["url", "node"], {"accesses": ("distinct", "time")}, "n_rows")


def p2_url_join(spark: SparkSession, d: str) -> DataFrame:
    """Per url, the many-to-many join of accesses and page views without its rows."""
    access, stored = table(spark, d, "access_log"), table(spark, d, "pageview")
    return eager_join_aggregate(access, stored, ["url"], {"first_time": ("min", "time"), "with_referrer": ("count", "referrer")}, {"views": ("sum", "pageview")})


def p2_node_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per node, the join of accesses and page views on url and node, rolled up from its states."""
    access, stored = table(spark, d, "access_log"), table(spark, d, "pageview")
    return eager_join_aggregate(access, stored, ["url", "node"], {"last_time": ("max", "time"), "with_referrer": ("count", "referrer")}, {"views": ("sum", "pageview"), "least": ("min", "pageview")}, rollup=["node"])


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    return phase_space_faults(table(spark, d, "grid_node_metrics"), "metrics_id", "node", "last_update_time", METRIC_FIELDS, "collected_at")


def p5_faults(spark: SparkSession, d: str) -> DataFrame:
    """The faults that p5_method finds besides spikes."""
    return p5_method(spark, d).where("fault <> 'spike'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    faults = measurement_faults(table(spark, d, "grid_node_metrics"), "metrics_id", "node", "last_update_time", METRIC_FIELDS, "collected_at")
    return faults.select("metrics_id", "field")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    access = table(spark, d, "access_log").select("url", "time").where("time is not null")
    first, last = access.agg(day_number(F.min("time")), day_number(F.max("time"))).first()
    once = access.distinct().select("url", day_number("time").alias("day"))
    return rolling_totals(once, "url", "day", periods=(7, 30), first=first, last=last)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cases = _rolling(spark, d).where((F.col("total") == 0) & (F.col("total_7") >= 20) & (F.col("total_7") * 10 >= F.col("total_30") * 7))
    return cases.select("url", day_string("day").alias("day"))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).withColumn("day", day_string("day"))


QUERIES = {f.__name__: f for f in (p2_found, p2_accesses, p2_url_join, p2_node_rollup, p5_method, p5_found, p5_faults, p6_found, p6_rolling)}

_P6 = """
with once as (select distinct url, time from access_log where time is not null and url is not null),
daily as (select url, cast(floor(time / 86400000.0) as integer) as d, count(*) as n from once group by 1, 2),
bounds as (select cast(floor(min(time) / 86400000.0) as integer) as lo, cast(floor(max(time) / 86400000.0) as integer) as hi from access_log),
cal as (select url, unnest(range(lo, hi + 1)) as d from (select distinct url from daily), bounds),
filled as (select cal.url, cast(cal.d as integer) as d, coalesce(n, 0) as n from cal left join daily on cal.url = daily.url and cal.d = daily.d),
rolled as (select url, d, n as total,
  cast(sum(n) over (partition by url order by d rows between 6 preceding and current row) as bigint) as total_7,
  cast(sum(n) over (partition by url order by d rows between 29 preceding and current row) as bigint) as total_30
  from filled)
"""

_P5_WITH = """
with m as (
  select metrics_id, node, last_update_time as t, cast(last_cpu_load as double) as last_cpu_load, last_io_wait,
    coalesce(last_update_time - epoch_ms(collected_at) > 3600000 or last_update_time - epoch_ms(collected_at) < -2592000000, false) as clock
  from grid_node_metrics),
long as (
  select metrics_id, node, t, 'last_cpu_load' as field, last_cpu_load as v from m where not clock and t is not null
  union all select metrics_id, node, t, 'last_io_wait', last_io_wait from m where not clock and t is not null),
possible as (select * from long where v >= 0 and v <= 1 and not isnan(v)),
once as (select node, field, t, max(v) as v from possible group by 1, 2, 3),
a as (select *, lag(v) over w as p, list(v) over (partition by node, field order by t rows between 4 preceding and 4 following) as near,
  row_number() over w as pos from once window w as (partition by node, field order by t)),
b as (select *, abs(v - p) as step, list_sort(near) as s, sum(case when v = p then 0 else 1 end) over (partition by node, field order by t) as run from a),
c as (select *, (s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) / 2 as mid,
  v <> 0 and count(*) over (partition by node, field, run) >= 10 as still from b),
u as (select node, field, median(step) as usual from c where step is not null group by 1, 2),
bad as (select c.node, c.field, c.t, still from c left join u on c.node is not distinct from u.node and c.field = u.field
  where still or abs(v - mid) > 8 * usual)
"""
_P5 = _P5_WITH + """
select metrics_id, 'last_update_time' as field from m where clock
union all select metrics_id, field from long where v is not null and not (v >= 0 and v <= 1 and not isnan(v))
union all select possible.metrics_id, possible.field from possible join bad
  on possible.node is not distinct from bad.node and possible.field = bad.field and possible.t = bad.t
"""

SQL = {
    "p2_found": """
      select p.url, p.node from pageview p left join (
        select url, node, count(distinct time) as seen from access_log where node is not null group by 1, 2) a
      on p.url = a.url and p.node = a.node
      where p.pageview is distinct from coalesce(a.seen, 0)""",
    "p2_accesses": "select url, node, count(*) as n_rows, count(distinct time) as accesses from access_log where node is not null group by 1, 2",
    "p2_url_join": """
      select a.url, count(*) as n_joined, min(time) as first_time, count(referrer) as with_referrer, cast(sum(pageview) as bigint) as views
      from access_log a join pageview p on a.url = p.url group by 1""",
    "p2_node_rollup": """
      select a.node, count(*) as n_joined, max(time) as last_time, count(referrer) as with_referrer, cast(sum(pageview) as bigint) as views, min(pageview) as least
      from access_log a join pageview p on a.url = p.url and a.node = p.node group by 1""",
    "p5_found": _P5,
    "p5_faults": _P5_WITH + """
      select metrics_id, 'last_update_time' as field, 'clock' as fault from m where clock
      union all select metrics_id, field, 'impossible' from long where v is not null and not (v >= 0 and v <= 1 and not isnan(v))
      union all select possible.metrics_id, possible.field, 'still' from possible join bad
        on possible.node is not distinct from bad.node and possible.field = bad.field and possible.t = bad.t and still""",
    "p6_found": _P6 + "select url, cast(date '1970-01-01' + d as varchar) as day from rolled where total = 0 and total_7 >= 20 and total_7 * 10 >= total_30 * 7",
    "p6_rolling": _P6 + "select url, cast(date '1970-01-01' + d as varchar) as day, total, total_7, total_7 / 7.0::double as avg_7, total_30, total_30 / 30.0::double as avg_30 from rolled",
}
