"""The 22 decision-support queries on the star schema: as one query, and as a map and a reduce query over fragments.

The tables here lack some columns of the public benchmark, so predicates on those are replaced (other dates, nations,
types) and partsupp is derived from lineitem. The plain text runs in Spark and in DuckDB alike. Money is rounded, as
sums of floating-point numbers depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from fragsql.operators.catalog import Catalog, TableSpec
from fragsql.operators.fragment import fragment_all
from fragsql.plans.twophase import execute, run_script, table_views
from fragsql.runtime import releases, table

PARTSUPP = """select l_partkey as ps_partkey, l_suppkey as ps_suppkey, cast(sum(l_quantity) as double) as ps_availqty,
  min(l_extendedprice / l_quantity) as ps_supplycost from lineitem group by l_partkey, l_suppkey"""

BASE = ("lineitem", "orders", "part", "customer", "supplier", "nation", "region")

SPECS = (
    TableSpec("lineitem", ("l_orderkey", "l_linenumber"), ((("l_orderkey",), "orders"), (("l_partkey", "l_suppkey"), "partsupp"), (("l_partkey",), "part"), (("l_suppkey",), "supplier"))),
    TableSpec("orders", ("o_orderkey",), ((("o_custkey",), "customer"),)),
    TableSpec("partsupp", ("ps_partkey", "ps_suppkey"), ((("ps_partkey",), "part"), (("ps_suppkey",), "supplier"))),
    TableSpec("part", ("p_partkey",)),
    TableSpec("customer", ("c_custkey",), ((("c_nationkey",), "nation"),)),
    TableSpec("supplier", ("s_suppkey",), ((("s_nationkey",), "nation"),)),
    TableSpec("nation", ("n_nationkey",), ((("n_regionkey",), "region"),)),
    TableSpec("region", ("r_regionkey",)),
)


class Pair(NamedTuple):
    plain: str
    map: str
    reduce: str
    pre_map: str | None = None
    pre_reduce: str | None = None


def catalog() -> Catalog:
    c = Catalog()
    c.register(SPECS)
    return c


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    out = {name: table(spark, d, name) for name in BASE}
    return out | {"partsupp": spark.sql(PARTSUPP.replace("from lineitem", "from {items}"), items=out["lineitem"])}


_NET = "l_extendedprice * (1 - l_discount)"
_Q8_FROM = """from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey
    and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA'
    and s_nationkey = n2.n_nationkey and o_orderdate between date '1995-01-01' and date '1996-12-31' and p_type = 'ECONOMY'"""
_Q7_FROM = """from supplier, lineitem, orders, customer, nation n1, nation n2
  where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey
    and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
    and ((n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1'))
    and l_shipdate between date '1995-01-01' and date '1996-12-31'"""
_Q11_FROM = "from partsupp, supplier, nation where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_1'"
_Q19_WHERE = """where p_partkey = l_partkey and (
    (p_brand = 'Brand#12' and l_quantity >= 1 and l_quantity <= 11 and p_size between 1 and 25)
    or (p_brand = 'Brand#23' and l_quantity >= 10 and l_quantity <= 20 and p_size between 1 and 40)
    or (p_brand = 'Brand#3' and l_quantity >= 20 and l_quantity <= 30 and p_size between 1 and 50))"""
_Q22_CODE = "substring(c_name from 18 for 1)"
_Q22_CODES = f"{_Q22_CODE} in ('1', '3', '5', '7', '9')"


def _q2(part: str, supply: str, inner: str) -> str:
    return f"""select s_acctbal, s_name, n_name, p_partkey, round(ps_supplycost, 6) as cost
  from part, supplier, partsupp, nation, region
  where {part}p_partkey = ps_partkey {supply}and s_suppkey = ps_suppkey and p_type like '%SMALL' and s_nationkey = n_nationkey
    and n_regionkey = r_regionkey and r_name = 'EUROPE' and ps_supplycost = (
      select min(ps_supplycost) from partsupp, supplier, nation, region
      where {inner}p_partkey = ps_partkey and s_suppkey = ps_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE')"""


def _q3(keyed: str, value: str) -> str:
    return f"""select l_orderkey, {value} as revenue, cast(o_orderdate as date) as o_orderdate
  from customer, orders, lineitem
  where {keyed}c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
    and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
  group by l_orderkey, o_orderdate"""


def _q4(keyed: str, inner: str) -> str:
    return f"""select o_orderpriority, count(*) as order_count from orders
  where {keyed}o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-07-01' + interval '3' month
    and exists (select * from lineitem where {inner}l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval '60' day)
  group by o_orderpriority"""


def _q5(keyed: str, value: str) -> str:
    return f"""select n_name, {value} as revenue from customer, orders, lineitem, supplier, nation, region
  where {keyed}c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey
    and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'
    and o_orderdate >= date '1996-01-01' and o_orderdate < date '1996-01-01' + interval '1' year
  group by n_name"""


def _q6(keyed: str) -> str:
    return f"""from lineitem where {keyed}l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '1' year
    and l_discount between 0.0499 and 0.0701 and l_quantity < 24"""


def _q9(keyed: str, value: str) -> str:
    return f"""select nation, o_year, {value} as sum_profit from (
    select n_name as nation, cast(extract(year from o_orderdate) as integer) as o_year, {_NET} - ps_supplycost * l_quantity as amount
    from part, supplier, lineitem, partsupp, orders, nation
    where {keyed}s_suppkey = l_suppkey and ps_suppkey = l_suppkey and ps_partkey = l_partkey and p_partkey = l_partkey
      and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%widget%') as profit
  group by nation, o_year"""


def _q10(keyed: str, value: str) -> str:
    return f"""select c_custkey, c_name, {value} as revenue, c_acctbal, n_name from customer, orders, lineitem, nation
  where {keyed}c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= date '1996-10-01'
    and o_orderdate < date '1996-10-01' + interval '3' month and l_returnflag = 'R' and c_nationkey = n_nationkey
  group by c_custkey, c_name, c_acctbal, n_name"""


def _q12(keyed: str) -> str:
    high = "o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH'"
    return f"""select l_returnflag, cast(sum(case when {high} then 1 else 0 end) as bigint) as high_line_count,
    cast(sum(case when {high} then 0 else 1 end) as bigint) as low_line_count
  from orders, lineitem where {keyed}o_orderkey = l_orderkey and l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '1' year
  group by l_returnflag"""


def _q13(customer: str, orders: str) -> str:
    return f"""select c_count, count(*) as custdist from (
    select c_custkey, count(o_orderkey) from customer left outer join orders
      on c_custkey = o_custkey and o_orderpriority not like '%URGENT%'{orders}
    {customer}group by c_custkey) as c_orders (c_custkey, c_count)
  group by c_count"""


def _q14(keyed: str, sums: str) -> str:
    return f"""select {sums} from lineitem, part where {keyed}l_partkey = p_partkey
    and l_shipdate >= date '1995-09-01' and l_shipdate < date '1995-09-01' + interval '1' month"""


def _q16(keyed: str) -> str:
    return f"""select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from partsupp, part
  where {keyed}p_partkey = ps_partkey and p_brand <> 'Brand#45' and p_type not like 'MEDIUM%'
    and p_size in (49, 14, 23, 45, 19, 3, 36, 9) and ps_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)
  group by p_brand, p_type, p_size"""


def _q17(keyed: str, inner: str) -> str:
    return f"""from lineitem, part where {keyed}p_partkey = l_partkey and p_brand = 'Brand#23'
    and l_quantity < (select 0.2 * avg(l_quantity) from lineitem where {inner}l_partkey = p_partkey)"""


def _q18(keyed: str, inner: str) -> str:
    return f"""select c_name, c_custkey, o_orderkey, cast(o_orderdate as date) as o_orderdate, o_totalprice, sum(l_quantity) as quantity
  from customer, orders, lineitem
  where {keyed}o_orderkey in (select l_orderkey from lineitem {inner}group by l_orderkey having sum(l_quantity) > 300)
    and c_custkey = o_custkey and o_orderkey = l_orderkey
  group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice"""


def _q20(supplier: str, supply: str, item: str) -> str:
    return f"""select s_name, s_suppkey from supplier, nation
  where {supplier}s_suppkey in (
      select ps_suppkey from partsupp
      where {supply}ps_partkey in (select p_partkey from part where p_name like 'small%')
        and ps_availqty > (
          select 0.5 * sum(l_quantity) from lineitem where {item}l_partkey = ps_partkey and l_suppkey = ps_suppkey
            and l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '1' year))
    and s_nationkey = n_nationkey and n_name = 'NATION_3'"""


def _q21(l1: str, l2: str, l3: str) -> str:
    late = "l_shipdate > o_orderdate + interval '90' day"
    return f"""select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation
  where {l1}s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.{late}
    and exists (select * from lineitem l2 where {l2}l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
    and not exists (select * from lineitem l3 where {l3}l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.{late})
    and s_nationkey = n_nationkey and n_name in ('NATION_2', 'NATION_3', 'NATION_4')
  group by s_name"""


def _q22(keyed: str, average: str, inner: str, value: str) -> str:
    return f"""select cntrycode, count(*) as numcust, {value} as totacctbal from (
    select {_Q22_CODE} as cntrycode, c_acctbal from customer
    where {keyed}{_Q22_CODES} and c_acctbal > {average}
      and not exists (select * from orders where {inner}o_custkey = c_custkey and o_orderdate < date '1996-01-01')) as custsale
  group by cntrycode"""


_LINE = "lineitem partitioned by (primarykey) and "
_BY_ORDER = "lineitem partitioned by (l_orderkey) and orders partitioned by (o_orderkey) and "
_BY_PART = "part partitioned by (p_partkey) and lineitem partitioned by (l_partkey) and "
_NAT7 = "n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as integer) as l_year"
_AVG22 = f"(select avg(c_acctbal) from customer where c_acctbal > 0.00 and {_Q22_CODES})"
_Q15_SUM = f"""select l_suppkey as supplier_no, round(sum({_NET}), 4) as total_revenue from lineitem
  where {{}}l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '3' month group by l_suppkey"""
_Q15_END = "select s_suppkey, s_name, total_revenue from supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue)"

PAIRS: dict[str, Pair] = {
    "q01_pricing_summary": Pair(
        f"""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
  round(sum({_NET}), 4) as sum_disc_price, round(sum({_NET} * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty,
  round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= date '1998-12-01' - interval '90' day group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
        f"""select l_returnflag, l_linestatus, sum(l_quantity) as q, sum(l_extendedprice) as p, sum({_NET}) as net, sum({_NET} * (1 + l_tax)) as charge,
  sum(l_discount) as disc, count(*) as n
from lineitem where {_LINE}l_shipdate <= date '1998-12-01' - interval '90' day (3) group by l_returnflag, l_linestatus""",
        """select l_returnflag, l_linestatus, sum(q) as sum_qty, round(sum(p), 2) as sum_base_price, round(sum(net), 4) as sum_disc_price,
  round(sum(charge), 2) as sum_charge, round(sum(q) / cast(sum(n) as double), 4) as avg_qty, round(sum(p) / cast(sum(n) as double), 4) as avg_price,
  round(sum(disc) / cast(sum(n) as double), 6) as avg_disc, sum(n) as count_order
from <src> group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
    ),
    "q02_minimum_cost_supplier": Pair(
        _q2("", "", "") + " order by s_acctbal desc, n_name, s_name, p_partkey limit 100",
        _q2("part partitioned by (p_partkey) and partsupp partitioned by (ps_partkey) and ", "", "partsupp partitioned by (ps_partkey) and "),
        "select * from <src> order by s_acctbal desc, n_name, s_name, p_partkey limit 100",
    ),
    "q03_shipping_priority": Pair(
        _q3("", f"round(sum({_NET}), 4)") + " order by revenue desc, o_orderdate, l_orderkey limit 10",
        _q3(_BY_ORDER, f"sum({_NET})"),
        "select l_orderkey, round(sum(revenue), 4) as revenue, o_orderdate from <src> group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10",
    ),
    "q04_order_priority": Pair(
        _q4("", "") + " order by o_orderpriority",
        _q4("orders partitioned by (o_orderkey) and ", "lineitem partitioned by (l_orderkey) and "),
        "select o_orderpriority, sum(order_count) as order_count from <src> group by o_orderpriority order by o_orderpriority",
    ),
    "q05_local_supplier_volume": Pair(
        _q5("", f"round(sum({_NET}), 4)") + " order by revenue desc",
        _q5(_LINE, f"sum({_NET})"),
        "select n_name, round(sum(revenue), 4) as revenue from <src> group by n_name order by revenue desc",
    ),
    "q06_forecast_revenue": Pair(
        "select round(sum(l_extendedprice * l_discount), 4) as revenue " + _q6(""),
        "select sum(l_extendedprice * l_discount) as revenue " + _q6(_LINE),
        "select round(sum(revenue), 4) as revenue from <src>",
    ),
    "q07_volume_shipping": Pair(
        f"select supp_nation, cust_nation, l_year, round(sum(volume), 4) as revenue from (select {_NAT7}, {_NET} as volume {_Q7_FROM}) as shipping group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year",
        f"select supp_nation, cust_nation, l_year, sum(volume) as revenue from (select {_NAT7}, {_NET} as volume {_Q7_FROM} and lineitem partitioned by (primarykey)) as shipping group by supp_nation, cust_nation, l_year",
        "select supp_nation, cust_nation, l_year, round(sum(revenue), 4) as revenue from <src> group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year",
    ),
    "q08_market_share": Pair(
        f"select o_year, round(sum(case when nation = 'NATION_1' then volume else 0 end) / sum(volume), 6) as mkt_share from (select cast(extract(year from o_orderdate) as integer) as o_year, {_NET} as volume, n2.n_name as nation {_Q8_FROM}) as all_nations group by o_year order by o_year",
        f"select o_year, sum(case when nation = 'NATION_1' then volume else 0 end) as mine, sum(volume) as every from (select cast(extract(year from o_orderdate) as integer) as o_year, {_NET} as volume, n2.n_name as nation {_Q8_FROM} and lineitem partitioned by (primarykey)) as all_nations group by o_year",
        "select o_year, round(sum(mine) / sum(every), 6) as mkt_share from <src> group by o_year order by o_year",
    ),
    "q09_product_profit": Pair(
        _q9("", "round(sum(amount), 2)") + " order by nation, o_year desc",
        _q9(_LINE, "sum(amount)"),
        "select nation, o_year, round(sum(sum_profit), 2) as sum_profit from <src> group by nation, o_year order by nation, o_year desc",
    ),
    "q10_returned_items": Pair(
        _q10("", f"round(sum({_NET}), 4)") + " order by revenue desc, c_custkey limit 20",
        _q10(_LINE, f"sum({_NET})"),
        "select c_custkey, c_name, round(sum(revenue), 4) as revenue, c_acctbal, n_name from <src> group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20",
    ),
    "q11_important_stock": Pair(
        f"select ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) as value {_Q11_FROM} group by ps_partkey having sum(ps_supplycost * ps_availqty) > (select sum(ps_supplycost * ps_availqty) * 0.0001 {_Q11_FROM}) order by value desc, ps_partkey",
        f"select ps_partkey, sum(ps_supplycost * ps_availqty) as value {_Q11_FROM} and partsupp partitioned by (ps_partkey) group by ps_partkey having sum(ps_supplycost * ps_availqty) > <src>",
        "select ps_partkey, round(sum(value), 2) as value from <src> group by ps_partkey order by value desc, ps_partkey",
        f"select sum(ps_supplycost * ps_availqty) * 0.0001 as least {_Q11_FROM} and partsupp partitioned by (ps_partkey)",
        "select sum(least) from <src>",
    ),
    "q12_shipping_modes": Pair(
        _q12("") + " order by l_returnflag",
        _q12(_LINE),
        "select l_returnflag, sum(high_line_count) as high_line_count, sum(low_line_count) as low_line_count from <src> group by l_returnflag order by l_returnflag",
    ),
    "q13_customer_distribution": Pair(
        _q13("", "") + " order by custdist desc, c_count desc",
        _q13("where customer partitioned by (c_custkey) ", " and orders partitioned by (o_custkey)"),
        "select c_count, sum(custdist) as custdist from <src> group by c_count order by custdist desc, c_count desc",
    ),
    "q14_promotion_effect": Pair(
        _q14("", f"round(100.00 * sum(case when p_type like 'PROMO%' then {_NET} else 0 end) / sum({_NET}), 6) as promo_revenue"),
        _q14(_LINE, f"sum(case when p_type like 'PROMO%' then {_NET} else 0 end) as promo, sum({_NET}) as every"),
        "select round(100.00 * sum(promo) / sum(every), 6) as promo_revenue from <src>",
    ),
    "q15_top_supplier": Pair(
        f"create view revenue (supplier_no, total_revenue) as {_Q15_SUM.format('')}; {_Q15_END} order by s_suppkey; drop view revenue;",
        f"create view revenue (supplier_no, total_revenue) as {_Q15_SUM.format('lineitem partitioned by (l_suppkey) and ')}; select s_suppkey, s_name, total_revenue from supplier, revenue where supplier partitioned by (s_suppkey) and s_suppkey = supplier_no; drop view revenue;",
        "select s_suppkey, s_name, total_revenue from <src> where total_revenue = (select max(total_revenue) from <src>) order by s_suppkey",
    ),
    "q16_parts_supplier": Pair(
        _q16("") + " order by supplier_cnt desc, p_brand, p_type, p_size",
        # suppliers don't span shards, so that counts of different ones add up
        _q16("partsupp partitioned by (ps_suppkey) and "),
        "select p_brand, p_type, p_size, sum(supplier_cnt) as supplier_cnt from <src> group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size",
    ),
    "q17_small_quantity": Pair(
        "select round(sum(l_extendedprice) / 7.0, 6) as avg_yearly " + _q17("", ""),
        "select sum(l_extendedprice) as price " + _q17(_BY_PART, "lineitem partitioned by (l_partkey) and "),
        "select round(sum(price) / 7.0, 6) as avg_yearly from <src>",
    ),
    "q18_large_volume_customer": Pair(
        _q18("", "") + " order by o_totalprice desc, o_orderdate, o_orderkey limit 100",
        _q18(_BY_ORDER, "where lineitem partitioned by (l_orderkey) "),
        "select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, quantity from <src> order by o_totalprice desc, o_orderdate, o_orderkey limit 100",
    ),
    "q19_discounted_revenue": Pair(
        f"select round(sum({_NET}), 4) as revenue from lineitem, part {_Q19_WHERE}",
        f"select sum({_NET}) as revenue from lineitem, part {_Q19_WHERE} and lineitem partitioned by (primarykey)",
        "select round(sum(revenue), 4) as revenue from <src>",
    ),
    "q20_part_promotion": Pair(
        _q20("", "", "") + " order by s_name",
        _q20("supplier partitioned by (s_suppkey) and ", "partsupp partitioned by (ps_suppkey) and ", "lineitem partitioned by (l_suppkey) and "),
        "select s_name, s_suppkey from <src> order by s_name",
    ),
    "q21_waiting_suppliers": Pair(
        _q21("", "", "") + " order by numwait desc, s_name limit 100",
        _q21(*[f"lineitem partitioned by (l_orderkey) alias l{i} and " for i in (1, 2, 3)]),
        "select s_name, sum(numwait) as numwait from <src> group by s_name order by numwait desc, s_name limit 100",
    ),
    "q22_sales_opportunity": Pair(
        _q22("", _AVG22, "", "round(sum(c_acctbal), 2)") + " order by cntrycode",
        _q22("customer partitioned by (c_custkey) and ", "<src>", "orders partitioned by (o_custkey) and ", "sum(c_acctbal)"),
        "select cntrycode, sum(numcust) as numcust, round(sum(totacctbal), 2) as totacctbal from <src> group by cntrycode order by cntrycode",
        f"select sum(c_acctbal) as s, count(c_acctbal) as n from customer where customer partitioned by (c_custkey) and c_acctbal > 0.00 and {_Q22_CODES}",
        "select sum(s) / cast(sum(n) as double) from <src>",
    ),
}

SHARDS = 3
_fragments: dict[tuple[str, str, int, str, int], dict[str, DataFrame]] = {}


def fragments(spark: SparkSession, d: str, shards: int = SHARDS, by: str = "xxhash64") -> dict[str, DataFrame]:
    """The tables of d in fragments, staged once for a session."""
    key = (spark.sparkContext.applicationId, d, shards, by, len(releases))
    if key not in _fragments:
        _fragments[key] = fragment_all(tables(spark, d), catalog(), shards, by)
    return _fragments[key]


def plain(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        with table_views(spark, tables(spark, d)):
            return run_script(spark, PAIRS[name].plain)

    return run


def two_phase(name: str, shards: int = SHARDS) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = PAIRS[name]
        return execute(spark, p.map, p.reduce, fragments(spark, d, shards), shards, catalog(), p.pre_map, p.pre_reduce).value

    return run


QUERIES = {name: plain(name) for name in PAIRS} | {"mr_" + name: two_phase(name) for name in PAIRS}


def _oracle(name: str) -> str:
    text = PAIRS[name].plain
    if name == "q15_top_supplier":
        return f"with revenue as ({_Q15_SUM.format('')}) {_Q15_END}"
    return f"with partsupp as ({PARTSUPP}) {text}" if "partsupp" in text else text


SQL = {prefix + name: _oracle(name) for prefix in ("", "mr_") for name in PAIRS}
