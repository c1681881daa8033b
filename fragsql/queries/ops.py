"""Queries of single operators, with their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragsql.functions import hashes, text
from fragsql.operators import fragment as fr
from fragsql.operators import kmeans, mapreduce
from fragsql.operators.catalog import SHARD
from fragsql.operators.kv import KVStore
from fragsql.plans.twophase import execute, run_script, table_views
from fragsql.queries.tpch import SHARDS, catalog, fragments, tables
from fragsql.runtime import shared_dir, stage, table
from fragsql.sources import csvio
from fragsql.streaming.counts import partial_counts, total_counts

#: Statements that run alike in Spark and DuckDB, over the tables without partsupp.
SAME_SQL = {
    "op_projection_arithmetic": "select l_orderkey, l_linenumber, l_quantity * 2 + 1 as a, -l_quantity as b, l_quantity - l_tax as c from lineitem",
    "op_logic_and_comparison": "select count(*) as n from lineitem where (l_quantity >= 10 and l_quantity <> 20 or not l_tax < 0.05) and l_discount <= 0.08",
    "op_between": "select o_orderkey from orders where o_totalprice between 1000 and 200000 and o_orderdate between date '1996-01-01' and date '1997-12-31'",
    "op_in_list": "select p_partkey, p_size from part where p_size in (1, 7, 49) and p_brand not in ('Brand#1', 'Brand#2')",
    "op_like": "select p_partkey, p_type from part where p_type like 'S%' or p_type like '%M' or p_name like '%widget%' and p_name not like '%a%e%'",
    "op_case": "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 50000 then 'middle' else 'low' end as class from orders",
    "op_bitwise_and": "select l_linenumber & 5 as bits, count(*) as n from lineitem where l_linenumber & 1 = 1 or (l_linenumber & 6) <> 0 group by l_linenumber & 5",
    "op_extract_substring": "select cast(extract(year from o_orderdate) as integer) as y, substring(o_orderpriority from 1 for 1) as p, count(*) as n from orders group by 1, 2",
    "op_derived_column_names": "select a, count(*) as n from (select o_orderstatus, o_custkey from orders) as t (a, b) group by a",
    "op_join_all": """select count(*) as n from lineitem, orders, customer, part, supplier, nation n1, nation n2, region
      where l_orderkey = o_orderkey and o_custkey = c_custkey and l_partkey = p_partkey and l_suppkey = s_suppkey
        and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and n1.n_regionkey = r_regionkey""",
    "op_join_residual": "select count(*) as n from customer inner join orders on c_custkey = o_custkey and o_totalprice > c_acctbal * 10",
    "op_left_outer_join": "select c_custkey, count(o_orderkey) as n from customer left outer join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey",
    "op_outer_as_union": """select c_custkey, count(*) as n from customer inner join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey
      union all select c_custkey, 0 as n from customer where not exists (select * from orders where o_custkey = c_custkey and o_orderstatus = 'F')""",
    "op_self_join": "select a.n_name as a, b.n_name as b from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "op_semi_exists": "select c_custkey from customer where exists (select * from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "op_anti_not_exists": "select c_custkey from customer where not exists (select * from orders where o_custkey = c_custkey)",
    "op_anti_not_in": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "op_semi_in_having": "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 250)",
    "op_semi_non_equi": "select l_orderkey, l_suppkey from lineitem l1 where exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)",
    "op_one_row_subqueries": "select o.n as orders_n, c.n as customer_n from (select count(*) as n from orders) o, (select count(*) as n from customer) c",
    "op_sum_count_avg_min_max": """select l_returnflag, sum(l_quantity) as s, count(*) as n, count(l_tax) as n_tax, round(avg(l_quantity), 6) as a, min(l_shipdate) as lo, max(l_extendedprice) as hi
      from lineitem group by l_returnflag""",
    "op_stddev": "select l_linestatus, round(stddev(l_quantity), 6) as sd from lineitem group by l_linestatus",
    "op_count_distinct": "select l_returnflag, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag",
    "op_conditional_sum": "select o_orderstatus, cast(sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as bigint) as urgent from orders group by o_orderstatus",
    "op_ratio_of_sums": "select l_linestatus, round(100.0 * sum(l_quantity * l_discount) / sum(l_quantity), 6) as percent from lineitem group by l_linestatus",
    "op_group_by_expression": "select cast(extract(month from l_shipdate) as integer) as m, l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by 1, 2, 3, 4",
    "op_having_scalar": "select l_suppkey, sum(l_quantity) as q from lineitem group by l_suppkey having sum(l_quantity) > (select 1.2 * sum(l_quantity) / count(distinct l_suppkey) from lineitem)",
    "op_aggregate_of_aggregate": "select n, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) as x group by n",
    "op_global_aggregate": "select count(*) as n, min(o_orderdate) as first_day, max(o_orderdate) as last_day from orders",
    "op_order_by": "select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment desc, c_acctbal, c_custkey",
    "op_order_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "op_union_all": "select c_nationkey as k from customer union all select s_nationkey from supplier",
    "op_union_distinct": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "op_except_distinct": "select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 0",
    "op_select_distinct": "select distinct p_brand, p_type from part",
    "op_scalar_subquery": "select s_suppkey, s_acctbal from supplier where s_acctbal > (select avg(s_acctbal) from supplier)",
    "op_correlated_scalar": "select o_orderkey from orders o where o_totalprice > (select 1.5 * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "op_page_views": "select url, count(*) as pageview from access_log group by url",
    "op_group_size_histogram": "select n, count(*) as urls from (select url, count(*) as n from access_log group by url) as x group by n",
}


def _same(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        with table_views(spark, tables(spark, d) | {"access_log": table(spark, d, "access_log")}):
            return run_script(spark, sql)

    return run


# -- key predicates: keys are order keys as text ------------------------------------------------------------------

#: name -> (operands, the condition on the text k)
PREDICATES = {
    "any": ((), "true"),
    "eq": (("1000",), "k = '1000'"),
    "ne": (("1000",), "k <> '1000'"),
    "gt": (("5",), "k > '5'"),
    "ge": (("500",), "k >= '500'"),
    "lt": (("20",), "k < '20'"),
    "le": (("20",), "k <= '20'"),
    "bw": (("10", "20"), "k between '10' and '20'"),
    "nbw": (("10", "20"), "k <= '10' or k >= '20'"),
    "bwx": (("10", "20"), "k > '10' and k < '20'"),
    "nbwx": (("10", "20"), "k not between '10' and '20'"),
    "in": (("1", "22", "none", "333"), "k in ('1', '22', 'none', '333')"),
    "not_in": (("1", "22", "none", "333"), "k not in ('1', '22', 'none', '333')"),
    "start_with": (("12",), "k like '12%'"),
    "not_start_with": (("12",), "k not like '12%'"),
}


def _index(op: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        kv = KVStore(spark, f"{shared_dir(spark)}/fragsql-kv-{uuid.uuid4().hex}")
        kv.add_records("orders", table(spark, d, "orders"), ["o_orderkey"])
        return kv.scan("orders", op, *PREDICATES[op][0]).select(F.col("key").cast("string").alias("k"))

    return run


def _store(spark: SparkSession, d: str) -> KVStore:
    """A store with the order keys of every customer in the index orders, and the customers' names in names."""
    kv = KVStore(spark, f"{shared_dir(spark)}/fragsql-kv-{uuid.uuid4().hex}")
    text_ = lambda c: F.col(c).cast("string").cast("binary")
    kv.add("orders", table(spark, d, "orders").select(text_("o_custkey").alias("key"), text_("o_orderkey").alias("value")))
    kv.add("names", table(spark, d, "customer").select(text_("c_custkey").alias("key"), text_("c_name").alias("value")))
    return kv


def op_multi_get(spark: SparkSession, d: str) -> DataFrame:
    """From the rows, not the arrays, of multi_get: a key with very many values is combined before it moves."""
    found = _store(spark, d).multi_get_rows("orders", table(spark, d, "customer").select(F.col("c_custkey").cast("string").cast("binary").alias("key")))
    sizes = found.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.col("value").cast("string").cast("bigint")).alias("last"))
    return sizes.select(F.col("key").cast("string").alias("k"), "n", "last")


def op_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).prefix_search("orders", "1").select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def op_put_replaces(spark: SparkSession, d: str) -> DataFrame:
    kv = _store(spark, d)
    kv.put("names", table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("key"), F.lit("in debt").alias("value")))
    return kv.table("names").select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def op_remove(spark: SparkSession, d: str) -> DataFrame:
    kv = _store(spark, d)
    kv.remove("names", "1", "2", "33")
    return kv.scan("names").select(F.col("key").cast("string").alias("k"))


# -- map-reduce -----------------------------------------------------------------------------------------------------


def op_map_reduce_page_views(spark: SparkSession, d: str) -> DataFrame:
    access = table(spark, d, "access_log").select("url")
    add = lambda k, values: [(k, sum(values))]
    return mapreduce.map_reduce(access, lambda url: [(url, 1)], "url string, n bigint", add, "url string, pageview bigint", combiner=add)


def op_map_with_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderpriority", "o_custkey")
    mapped = mapreduce.map_phase(rows, lambda p, c: [(p[2:], c % 10)], "priority string, digit bigint", skip=lambda p, c: p.startswith("5"))
    return mapped.groupBy("priority", "digit").agg(F.count(F.lit(1)).alias("n"))


def op_map_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """A bigint far beyond 2^53 beside nulls and NaN, through a map and a reduce."""
    big = F.lit((1 << 60) + 1) + F.col("o_orderkey")
    share = F.when(F.col("o_orderkey") % 5 == 1, F.lit(float("nan"))).when(F.col("o_orderkey") % 5 != 2, F.col("o_totalprice"))
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, big).alias("id"), share.alias("price"))
    mapped = mapreduce.map_phase(rows, lambda i, p: [(p, i)], "price double, id bigint")
    reduced = mapreduce.reduce_phase(mapped, lambda p, ids: [(p, i) for i in ids], "price double, id bigint")
    return reduced.select("id", F.coalesce(F.col("price").cast("string"), F.lit("none")).substr(1, 3).alias("kind"), F.nanvl("price", F.lit(-1.0)).alias("price"))


def op_reduced_map(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return mapreduce.reduced_map(rows, lambda k, values: [(len(list(values)), k)], "n bigint, o_custkey bigint")


# -- fragments --------------------------------------------------------------------------------------------------------


def _family_counts(primary: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c, parts, out = catalog(), fragments(spark, d), None
        for name, df in parts.items():
            spec = c.spec(name)
            for to in [name] if primary else [to for _, to in spec.fks]:
                one = fr.family(df, c.bit(to)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(to).alias("family"), "n")
                out = one if out is None else out.unionAll(one)
        return out

    return run


def op_hidden_join_is_local(spark: SparkSession, d: str) -> DataFrame:
    """Joins within shards along every foreign key, counted once by the copies of the referencing table's own key."""
    c, parts, out = catalog(), fragments(spark, d), None
    for name, df in parts.items():
        for cols, to in c.spec(name).fks:
            own = fr.family(df, c.bit(name)).select(SHARD, *cols)
            on = own[SHARD] == parts[to][SHARD]
            for a, b in zip(cols, c.spec(to).pk, strict=True):
                on &= own[a] == parts[to][b]
            one = own.join(parts[to].select(SHARD, *c.spec(to).pk), on).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(to).alias("family"), "n")
            out = one if out is None else out.unionAll(one)
    return out


def op_partitioned_by(spark: SparkSession, d: str) -> DataFrame:
    sql = "select '{0}' as name, count(*) as n from {0} where {0} partitioned by (primarykey)"
    both = " union all ".join(sql.format(t) for t in ("lineitem", "orders", "customer", "nation"))
    return execute(spark, both, "select name, sum(n) as n from <src> group by name", fragments(spark, d), SHARDS, catalog()).value


def op_two_phase_view(spark: SparkSession, d: str) -> DataFrame:
    name = execute(spark, "select o_orderstatus as s, count(*) as n from orders where orders partitioned by (primarykey) group by o_orderstatus", "select s, sum(n) as n from <src> group by s", fragments(spark, d), SHARDS, catalog(), output="view", name="status_counts").value
    return spark.table(name)


def op_two_phase_scalar(spark: SparkSession, d: str) -> DataFrame:
    value = execute(spark, "select max(o_totalprice) as m from orders", "select max(m) from <src>", fragments(spark, d), SHARDS, catalog(), output="scalarString").value
    return spark.createDataFrame([(value,)], "value string")


def op_two_phase_csv(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/fragsql-{uuid.uuid4().hex}.csv"
    execute(spark, "select c_custkey, c_name, c_acctbal from customer where customer partitioned by (primarykey)", "select * from <src>", fragments(spark, d), SHARDS, catalog(), output="csv", name=path)
    return csvio.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double", sep=",")


def op_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").where("c_acctbal > 0")
    return fr.missing_keys(table(spark, d, "orders"), ["o_custkey"], rich, ["c_custkey"])


def op_complete_references(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "customer")
    rich = every.where("c_acctbal > 0")
    return fr.complete_references(rich, every, ["c_custkey"], op_missing_keys(spark, d)).select("c_custkey", "c_name")


# -- text in and out, functions, k-means, streams -----------------------------------------------------------------


def op_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/fragsql-csv-{uuid.uuid4().hex}"
    csvio.write_csv(table(spark, d, "access_log").select("url", "referrer", "time", "node"), path, sep="|")
    return csvio.read_csv(spark, path, "url string, referrer string, time bigint, node string", sep="|", multi_line=False)


def op_pick_fields(spark: SparkSession, d: str) -> DataFrame:
    lines = csvio.csv_lines(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), sep="\t")
    got = csvio.pick_fields(lines, "value", [1, 4])
    return got.select(got.fields[0].cast("bigint").alias("o_orderkey"), got.fields[1].alias("o_orderpriority"))


def op_composite_key(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    return items.select(csvio.join_keys(["l_suppkey", "l_partkey"], items.columns).alias("k")).distinct()


def op_text_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "access_log").select("url").distinct().select(
        "url", text.count_matches("url", "/").alias("slashes"), text.nth_index("url", "/", 2).alias("second"), text.strip_end("url", "/").alias("bare"),
        text.encode_hex("url").alias("hex"), text.decode_hex(text.encode_hex("url")).cast("string").alias("again"), text.is_number(F.regexp_extract("url", "[0-9]+", 0)).alias("digits"),
    )


def op_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "access_log").select("url").distinct().select("url", hashes.hash_column("md5", "url").alias("md5"), hashes.hash_column("sha1", "url").alias("sha1"))


def _start(spark: SparkSession, d: str) -> list[list[float]]:
    return [list(map(float, r["embedding"])) for r in table(spark, d, "embeddings").where("vec_id < 5").orderBy("vec_id").collect()]


def op_kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.assign(table(spark, d, "embeddings"), "embedding", _start(spark, d), "nearest").select("vec_id", "nearest")


def op_kmeans_means(spark: SparkSession, d: str) -> DataFrame:
    got = kmeans.means(table(spark, d, "embeddings"), "embedding", "label")
    return got.select("label", "n", F.posexplode("mean").alias("place", "m")).select("label", "n", "place", F.round("m", 6).alias("m"))


def op_kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = kmeans.fit(stage(table(spark, d, "embeddings").select("vec_id", "embedding"), "points"), "embedding", 5, start=_start(spark, d))
    _, labelled, turns = fitted
    return kmeans.group_sizes(labelled).withColumns({"iterations": F.lit(turns), "converged": F.lit(fitted.converged)})


def op_sample(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.sample(table(spark, d, "orders").select("o_orderkey"), 100, 1000, seed=7)


def op_stream_page_views(spark: SparkSession, d: str) -> DataFrame:
    """Page views from a stream in micro-batches, added up from the batches' partial counts."""
    at = f"{d}/access_log.parquet"
    reader = spark.readStream.schema(table(spark, d, "access_log").schema)
    stream = reader.parquet(at) if os.path.isdir(at) else reader.option("pathGlobFilter", "access_log.parquet").parquet(d)
    base = f"{shared_dir(spark)}/fragsql-stream-{uuid.uuid4().hex}"
    partial_counts(stream, ["url"], f"{base}/counts", f"{base}/progress").awaitTermination()
    return total_counts(spark.read.parquet(f"{base}/counts"), ["url"]).withColumnRenamed("n", "pageview")


_NAMED = (
    op_multi_get, op_prefix_scan, op_put_replaces, op_remove, op_map_reduce_page_views, op_map_with_skip, op_map_with_nulls, op_reduced_map, 
    op_hidden_join_is_local, op_partitioned_by, op_two_phase_view, op_two_phase_scalar, op_two_phase_csv, 
    op_missing_keys, op_complete_references, 
    op_csv_round_trip, op_pick_fields, op_composite_key, op_text_functions, op_hashes, op_kmeans_assign, op_kmeans_means,
    op_kmeans_fit, op_sample, op_stream_page_views,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _same(sql) for name, sql in SAME_SQL.items()},
    **{f"op_index_{op}": _index(op) for op in PREDICATES},
    "op_hidden_primary": _family_counts(True),
    "op_hidden_foreign": _family_counts(False),
    **{f.__name__: f for f in _NAMED},
}

_PS = "(select distinct l_partkey as ps_partkey, l_suppkey as ps_suppkey from lineitem)"
_SIZES = {t: t for t in ("lineitem", "orders", "part", "customer", "supplier", "nation", "region")} | {"partsupp": _PS}
_FOREIGN = [("lineitem", t) for t in ("orders", "partsupp", "part", "supplier")] + [("orders", "customer"), ("partsupp", "part"), ("partsupp", "supplier"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region")]


def _counts(pairs: list[tuple[str, str]]) -> str:
    return " union all ".join(f"select '{a}' as name, '{b}' as family, count(*) as n from {_SIZES[a]}" for a, b in pairs)


_DISTANCE = "list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"

SQL: dict[str, str] = {
    **SAME_SQL,
    **{f"op_index_{op}": f"select k from (select cast(o_orderkey as varchar) as k from orders) where {cond}" for op, (_, cond) in PREDICATES.items()},
    "op_hidden_primary": _counts([(t, t) for t in _SIZES]),
    "op_hidden_foreign": _counts(_FOREIGN),
    "op_hidden_join_is_local": _counts(_FOREIGN),
    "op_multi_get": "select cast(o_custkey as varchar) as k, cast(count(*) as integer) as n, max(o_orderkey) as last from orders where o_custkey in (select c_custkey from customer) group by o_custkey",
    "op_prefix_scan": "select cast(o_custkey as varchar) as k, cast(o_orderkey as varchar) as v from orders where cast(o_custkey as varchar) like '1%'",
    "op_put_replaces": "select cast(c_custkey as varchar) as k, case when c_acctbal < 0 then 'in debt' else c_name end as v from customer",
    "op_remove": "select cast(c_custkey as varchar) as k from customer where c_custkey not in (1, 2, 33)",
    "op_map_reduce_page_views": SAME_SQL["op_page_views"],
    "op_stream_page_views": SAME_SQL["op_page_views"],
    "op_map_with_skip": "select substring(o_orderpriority, 3) as priority, o_custkey % 10 as digit, count(*) as n from orders where o_orderpriority not like '5%' group by 1, 2",
    "op_map_with_nulls": """select case when o_orderkey % 3 <> 0 then 1152921504606846977 + o_orderkey end as id,
      case when o_orderkey % 5 = 1 then 'NaN' when o_orderkey % 5 = 2 then 'non' else substring(cast(o_totalprice as varchar), 1, 3) end as kind,
      case when o_orderkey % 5 = 1 then -1.0 when o_orderkey % 5 <> 2 then o_totalprice end as price from orders""",
    "op_reduced_map": "select count(*) as n, o_custkey from orders group by o_custkey",
    "op_partitioned_by": " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("lineitem", "orders", "customer", "nation")),
    "op_two_phase_view": "select o_orderstatus as s, count(*) as n from orders group by 1",
    "op_two_phase_scalar": "select cast(max(o_totalprice) as varchar) || 'd' as value from orders",
    "op_two_phase_csv": "select c_custkey, c_name, c_acctbal from customer",
    "op_missing_keys": "select distinct o_custkey as c_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)",
    "op_complete_references": "select c_custkey, c_name from customer where not c_acctbal > 0 and c_custkey in (select o_custkey from orders)",
    "op_csv_round_trip": "select url, referrer, time, node from access_log",
    "op_pick_fields": "select o_orderkey, o_orderpriority from orders",
    "op_composite_key": "select distinct l_partkey || '|' || l_suppkey as k from lineitem",
    "op_text_functions": """select url, cast(length(url) - length(replace(url, '/', '')) as integer) as slashes,
      cast(case when length(url) - length(replace(url, '/', '')) < 2 then -1 else instr(url, '/') + instr(substring(url, instr(url, '/') + 1), '/') - 1 end as integer) as second,
      rtrim(url, '/') as bare, hex(encode(url)) as hex, url as again, regexp_matches(url, '[0-9]') as digits from (select distinct url from access_log)""",
    "op_hashes": "select distinct url, md5(url) as md5, sha1(url) as sha1 from access_log",
    "op_kmeans_assign": f"select e.vec_id, cast(min_by(c.vec_id, ({_DISTANCE}, c.vec_id)) as integer) as nearest from embeddings e, (select * from embeddings where vec_id < 5) c group by e.vec_id",
    "op_kmeans_means": "select label, n, cast(i - 1 as integer) as place, round(m, 6) as m from (select label, i, avg(embedding[i]::double) as m, count(*) as n from embeddings, range(1, 65) t(i) group by 1, 2)",
}
