"""Queries of stores, placement, jobs, sources, sinks, functions, the flow language and the command line, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragsql.functions import arrays, codecs, hashes, text
from fragsql.operators import fragment as fr
from fragsql.operators import jobs, kmeans, mapreduce
from fragsql.operators.catalog import HIDDEN, SHARD, Catalog, NodeState
from fragsql.operators.kv import KVStore
from fragsql.operators.positions import number_rows
from fragsql.operators.ring import Ring
from fragsql.plans import cli
from fragsql.plans.flow import Processor
from fragsql.plans.twophase import execute
from fragsql.queries.tpch import SHARDS, catalog, fragments
from fragsql.runtime import shared_dir, stage, table
from fragsql.sources import configs, csvio, generators
from fragsql.sources.records import RecordSource

BY = "sha1"
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _path(spark: SparkSession, suffix: str = "") -> str:
    return f"{shared_dir(spark)}/fragsql-part-{uuid.uuid4().hex}{suffix}"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _ring(spark: SparkSession, d: str) -> Ring:
    return Ring([r["r_name"] for r in table(spark, d, "region").collect()], virtual=16)  # five names


def _key(c: str) -> F.Column:
    return F.col(c).cast("string").cast("binary")


# -- placement ----------------------------------------------------------------------------------------------------------


def op_plain_hash(spark: SparkSession, d: str) -> DataFrame:
    return fr.plain_hash(table(spark, d, "orders"), ["o_orderkey"], 8, BY).select("o_orderkey", SHARD)


def op_shard_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = fr.shard_stats(fr.plain_hash(table(spark, d, "lineitem"), ["l_orderkey"], 8, BY), 8)
    return stats.select("total", "most", "least", "mean", F.round("stddev", 6).alias("stddev"), F.round("percent", 6).alias("percent"))


def op_overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    got = fr.overlap_ratio(table(spark, d, "lineitem"), [["l_orderkey"], ["l_partkey"], ["l_suppkey"]], 4, BY)
    return got.select("n_keys", "n_copies", F.round("overlap", 9).alias("overlap"))


def op_multi_key_copies(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return fr.multi_key_copies(src, [["o_orderkey"], ["o_custkey"]], 4, BY).select("o_orderkey", "o_custkey", SHARD)


def op_fragment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Where every order is kept and why: by its own keys, and beside each of its items."""
    return fragments(spark, d, SHARDS, BY)["orders"].select("o_orderkey", SHARD, HIDDEN)


def _variant(variant: fr.Variant) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Customers beside their orders, the index met in one of the ways."""
        c, shards = catalog(), 4
        loaded = {"orders": fragments(spark, d, shards, BY)["orders"]}
        every = table(spark, d, "customer")
        source = [every.where("c_acctbal < 0"), every.where("c_acctbal >= 0 or c_acctbal is null")] if variant is fr.Variant.MULTI_GRACE else every
        return fr.fragment(source, c.spec("customer"), c, shards, loaded, BY, variant, 16).select("c_custkey", SHARD, HIDDEN)

    return run


def op_average_records(spark: SparkSession, d: str) -> DataFrame:
    """Average and deviation over shards of the rows of eight tables, from a pair of queries."""
    names = list(catalog().specs)
    counts = ", ".join(f"(select count(*) as n from {t} where {t} partitioned by (primarykey)) as x{i}" for i, t in enumerate(names))
    map_sql = "select " + ", ".join(f"x{i}.n as n_{t}" for i, t in enumerate(names)) + f" from {counts}"
    reduce_sql = " union all ".join(f"select '{t}' as name, round(avg(n_{t}), 6) as average, round(stddev(n_{t}), 6) as deviation from <src>" for t in names)
    return execute(spark, map_sql, reduce_sql, fragments(spark, d, SHARDS, BY), SHARDS, catalog()).value


def op_bulk_load(spark: SparkSession, d: str) -> DataFrame:
    """Fragments saved by shard, their number checked, and one shard read back."""
    parts, path = fragments(spark, d, SHARDS, BY)["customer"], _path(spark)
    fr.save_fragments(parts, path, expected=parts.count())
    return fr.family(spark.read.parquet(path), catalog().bit("customer")).where(F.col(SHARD) == 1).select("c_custkey", "c_name")


def op_ring_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", _ring(spark, d).column("c_name").alias("node"))


def op_ring_successors(spark: SparkSession, d: str) -> DataFrame:
    chosen = _ring(spark, d).successor_column("p_name", 3)
    return table(spark, d, "part").select("p_partkey", F.array_join(chosen, ",").alias("nodes"))


def op_output_keys(spark: SparkSession, d: str) -> DataFrame:
    return mapreduce.output_keys(table(spark, d, "orders").select("o_custkey", "o_orderkey"), _ring(spark, d))


def op_catalog_masters(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog()
    c.load_nodes(table(spark, d, "distribution_catalog"))
    keys = sorted({k for k, _ in c.nodes})
    return _rows(spark, [(k, m, len(c.slaves(m, k))) for k in keys for m in c.masters(k)], "distkey string, node string, slaves bigint")


def op_catalog_states(spark: SparkSession, d: str) -> DataFrame:
    """The catalog as a table, after every master of the default key has gone into maintenance."""
    c = Catalog()
    c.load_nodes(table(spark, d, "distribution_catalog").where("distkey = ''"))
    before = {m: c.set_state(m, NodeState.MAINTENANCE) for m in c.masters()}
    nodes, _ = c.tables(spark)
    known = F.col("node").isin(list(before))
    return nodes.select("node", "masternode", F.col("state").cast("int").alias("state"), known.alias("changed"))


def op_register_tables(spark: SparkSession, d: str) -> DataFrame:
    c = catalog()
    bits = _rows(spark, [(s.name, k) for s in c.specs.values() for k in c.bits_of(s.name, ["primarykey", *[x for cols, _ in s.fks for x in cols]])], "tablename string, bit int")
    return c.tables(spark)[1].join(bits, "tablename").select("tablename", F.col("id").cast("int").alias("id"), "bit")


# -- the store ----------------------------------------------------------------------------------------------------------


def op_exact_search(spark: SparkSession, d: str) -> DataFrame:
    kv = KVStore(spark, _path(spark))
    kv.add("of", table(spark, d, "orders").select(_key("o_custkey").alias("key"), _key("o_orderkey").alias("value")))
    return kv.exact_search("of", "22").select(F.col("value").cast("string").cast("bigint").alias("o_orderkey"))


def op_get(spark: SparkSession, d: str) -> DataFrame:
    kv = KVStore(spark, _path(spark), layout="hashed")
    kv.add("names", table(spark, d, "customer").select(_key("c_custkey").alias("key"), _key("c_name").alias("value")))
    return _rows(spark, [(k, v.decode()) for k in ("1", "70", "none") for v in kv.get("names", k)], "k string, v string")


def op_key_order(spark: SparkSession, d: str) -> DataFrame:
    """Places in the scan of a store filled in two steps."""
    kv, orders = KVStore(spark, _path(spark)), table(spark, d, "orders")
    for part in ("o_orderkey % 2 = 1", "o_orderkey % 2 = 0"):
        kv.add_records("orders", orders.where(part), ["o_orderkey"])
    return number_rows(kv.scan("orders").select(F.col("key").cast("string").alias("k")), "place")


def op_early_stop(spark: SparkSession, d: str) -> DataFrame:
    kv = KVStore(spark, _path(spark))
    kv.add_records("orders", table(spark, d, "orders"), ["o_orderkey"])
    return kv.scan("orders", "gt", "3", limit=25).select(F.col("key").cast("string").alias("k"))


def op_add_records(spark: SparkSession, d: str) -> DataFrame:
    kv, rows = KVStore(spark, _path(spark)), table(spark, d, "customer")
    kv.add_records("customers", rows, ["c_nationkey", "c_custkey"])
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return kv.records("customers", kinds)


def op_store_commands(spark: SparkSession, d: str) -> DataFrame:
    """What create, add, sync, purge and drop leave, and what the cache's commands answer."""
    kv = KVStore(spark, _path(spark))
    pairs = table(spark, d, "nation").select(_key("n_nationkey").alias("key"), _key("n_name").alias("value"))
    told = [("create", str(kv.create("a"))), ("again", str(kv.create("a")))]
    kv.add("b", pairs)
    kv.sync("a", "b")
    kv.purge_all(clear=False)
    told.append(("names", ",".join(kv.names())))
    replies = {c: kv.handle(c, "b", k, v) for c, k, v in (("get", "3", ""), ("GETK", "4", ""), ("getq", "none", ""), ("getk", "none", ""), ("setq", "5", "five"), ("set", "6", "six"), ("getkq", "5", ""), ("quitq", "", ""))}
    told += [(c, "silence" if r is None else "|".join(x.decode() if isinstance(x, bytes) else str(x or "") for x in r)) for c, r in replies.items()]
    told.append(("rows", str(kv.table("b").count())))
    kv.drop("a")
    told.append(("left", ",".join(kv.names())))
    kv.purge_all(clear=True)
    told.append(("purged", ",".join(kv.names())))
    return _rows(spark, told, "command string, answer string")


def op_replicas(spark: SparkSession, d: str) -> DataFrame:
    """Pairs kept at two nodes, read after one region's node died; and how many were kept at each node."""
    kv = KVStore(spark, _path(spark), ring=_ring(spark, d))
    kv.add("names", table(spark, d, "customer").select(_key("c_name").alias("key"), _key("c_custkey").alias("value")), replicas=1)
    alive = kv.table("names", without=["ASIA"]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("string").cast("bigint")).alias("keys")).select(F.lit("all").alias("node"), "n", "keys")
    each = kv._copies("names").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("string").cast("bigint")).alias("keys"))
    return alive.unionByName(each)


def op_add_at_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs put at nodes by name: found by a reader of the second when the first is dead, lost when both are."""
    kv = KVStore(spark, _path(spark), ring=_ring(spark, d))
    pairs = table(spark, d, "supplier").select(_key("s_suppkey").alias("key"), _key("s_name").alias("value"))
    kv.add_at("names", pairs, ["ASIA", "EUROPE"])
    kv.add_node("where", pairs, "EUROPE")
    sizes = [("first", kv.table("names")), ("second", kv.table("names", ["ASIA"])), ("lost", kv.table("names", ["ASIA", "EUROPE"])), ("mapped", kv.table("where").where(F.col("value").cast("string") == "EUROPE"))]
    out = None
    for name, df in sizes:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reader"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def op_plain_layout(spark: SparkSession, d: str) -> DataFrame:
    kv = KVStore(spark, _path(spark), layout="plain")
    kv.add_records("orders", table(spark, d, "orders"), ["o_orderkey"])
    return kv.scan("orders", "bw", "10", "20").select(F.col("key").cast("string").alias("k"))


# -- jobs and sinks -----------------------------------------------------------------------------------------------------


def op_reduce_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return mapreduce.reduce_phase(rows, lambda k, xs: [(k, *_ends(xs))], "o_custkey bigint, n bigint, first bigint, last bigint", skip=lambda k, v: v % 4 == 0, order=["o_orderkey"])


def _ends(values) -> tuple[int, int, int]:
    n, first, last = 0, None, None
    for last in values:
        first, n = last if n == 0 else first, n + 1
    return n, first, last


def _page_views(spark: SparkSession, d: str) -> DataFrame:
    pairs = mapreduce.map_phase(table(spark, d, "access_log").select("url"), jobs.one_for_each, "url string, n bigint", combiner=jobs.added_up)
    return mapreduce.reduce_phase(pairs, jobs.added_up, "url string, pageview bigint")


def op_scatter(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    mapreduce.scatter(_page_views(spark, d), "url", path)
    return spark.read.parquet(path)


def op_gather(spark: SparkSession, d: str) -> DataFrame:
    """The results of two jobs, gathered as tables and as one view over both."""
    name = f"gathered_{uuid.uuid4().hex}"
    views = _page_views(spark, d)
    for i, part in enumerate((views.where("pageview > 1"), views.where("pageview <= 1"))):
        part.write.mode("overwrite").parquet(path := _path(spark))
        spark.read.parquet(path).createOrReplaceTempView(f"{name}_{i}")
    mapreduce.gather_views([spark.table(f"{name}_{i}") for i in range(2)], name)
    return spark.table(name)


def op_split_job(spark: SparkSession, d: str) -> DataFrame:
    """A task for each nation: the length of its name; and the list of results folded into one."""
    names = [r["n_name"] for r in table(spark, d, "nation").collect()]
    each = mapreduce.split_job(spark, names, len, T.StringType(), T.LongType())
    total = mapreduce.aggregate_results(each, sum)
    return each.unionAll(_rows(spark, [("all", total)], "item string, result bigint"))


def op_task_policies(spark: SparkSession, d: str) -> DataFrame:
    """Which of 25 tasks' results are kept if an error is skipped, and if a result ends the job with or without itself."""
    items = sorted(r["n_nationkey"] for r in table(spark, d, "nation").collect())
    P = jobs.Policy

    def work(k: int) -> int:
        if k % 5 == 3:
            raise ValueError(k)
        return k * k

    def ended(by: jobs.Policy) -> Callable:
        return lambda k, result, error: P.SKIP if error else by if k == 12 else P.CONTINUE

    policies = {"skip": lambda k, result, error: P.SKIP if error else P.CONTINUE, "return": ended(P.RETURN), "cancel": ended(P.CANCEL_RETURN)}
    kept = [(name, k, r) for name, p in policies.items() for k, r in jobs.run_tasks(spark, items, work, T.IntegerType(), T.LongType(), p, at_once=1 if name != "skip" else None)]
    return _rows(spark, kept, "policy string, k int, result bigint")


def _derby() -> str:
    return f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"


@contextmanager
def _derby_files(spark: SparkSession) -> Iterator[str]:
    """A database in files, since the driver's memory may not hold it, until the block ends."""
    with tempfile.TemporaryDirectory(prefix="fragsql-") as folder:
        yield f"jdbc:derby:{folder}/db;create=true"
        try:
            spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{folder}/db;shutdown=true")
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # Derby's word for done
                raise


def op_database_job(spark: SparkSession, d: str) -> DataFrame:
    """A table of a database mapped, reduced and written to a table of another; the command line runs the same."""
    with _derby_files(spark) as source, _derby_files(spark) as target:
        return _database_job(spark, d, source, target)


def _database_job(spark: SparkSession, d: str, source: str, target: str) -> DataFrame:
    csvio.write_jdbc(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), source, "ORD", replace=False, driver=DERBY)
    conf = ["job", "--url", source, "--query", 'select "o_orderpriority", "o_orderkey" from ORD', "--mapper", "fragsql.operators.jobs:one_for_each", "--combiner", "fragsql.operators.jobs:added_up", "--shuffle", "p string, n bigint"]
    conf += ["--reducer", "fragsql.operators.jobs:added_up", "--schema", "p string, n bigint", "--output", "SUMS", "--output-url", target, "--driver", DERBY]
    cli.main(conf, spark)
    return stage(csvio.read_jdbc(spark, target, "select * from SUMS", driver=DERBY), "sums")


def op_execute_update(spark: SparkSession, d: str) -> DataFrame:
    """Rows that statements changed in a database."""
    url = _derby()
    csvio.write_jdbc(table(spark, d, "nation"), url, "NAT", replace=False, driver=DERBY)
    did = lambda sql: jobs.execute_update(spark, url, sql, DERBY)
    n = [("create", did("create table T (K int)")), ("insert", did('insert into T select "n_nationkey" from NAT where "n_regionkey" = 1')), ("delete", did("delete from T where K > 10"))]
    return _rows(spark, n, "statement string, n int")


def op_checked_append(spark: SparkSession, d: str) -> DataFrame:
    """A table made by a query, rows appended with a check of their number, and a wrong number told."""
    name = f"appended_{uuid.uuid4().hex}"
    supply = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    execute(spark, "select * from supplier where s_nationkey < 5", "select s_suppkey, s_nationkey from <src>", {"supplier": supply}, output="TABLE", name=name)
    csvio.append_checked(supply.where("s_nationkey >= 5"), name, supply.where("s_nationkey >= 5").count())
    out = stage(spark.table(name), "appended")
    try:
        csvio.append_checked(supply.limit(1), name, 2)
    except ValueError:
        out = out.withColumn("told", F.lit(True))
    spark.sql(f"drop table {name}")
    return out


# -- sources ------------------------------------------------------------------------------------------------------------


def op_header_csv(spark: SparkSession, d: str) -> DataFrame:
    path = csvio.write_csv_file(table(spark, d, "documents").select("doc_id", "text", "source"), _path(spark, ".csv"), header=True)
    got = csvio.read_csv(spark, path, sep=",", header=True)
    return got.select(F.col("DOC_ID").cast("bigint").alias("DOC_ID"), "TEXT", "SOURCE")


def op_number_files(spark: SparkSession, d: str) -> DataFrame:
    """Points written as text, read back from files found by suffix, and averaged by place."""
    path = _path(spark)
    for label in ("0", "1"):
        table(spark, d, "embeddings").where(f"label % 2 = {label}").select(F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")).write.text(f"{path}/half{label}")
    got = csvio.read_points(spark, path, ".txt").select(F.posexplode("features").alias("place", "x"))
    return got.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 9).alias("m"))


def op_generators(spark: SparkSession, d: str) -> DataFrame:
    """Whether random points fit their distributions: means and shares within five standard errors."""
    n = 20_000
    uni = generators.uniform(spark, n, 2, 1).agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg(F.col("features")[0]) - 0.5) < 5 * 0.2887 / n**0.5).alias("fits")).select(F.lit("uniform").alias("kind"), "n", "fits")
    zipf = generators.zipf(spark, n, 1.0, 10, 2, 2)  # the first of ten has 1 / 2.929
    zipf = zipf.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg((F.col("features")[1] == 1).cast("double")) - 0.3414) < 5 * 0.4742 / n**0.5).alias("fits")).select(F.lit("zipf").alias("kind"), "n", "fits")
    gauss = generators.gaussian(spark, n, [[0.0, 0.0], [9.0, -9.0]], 2.0, 3).groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("features")[1]).alias("m"), F.stddev(F.col("features")[1]).alias("s"))
    fits = (F.abs(F.col("m") + 9 * F.col("centre")) < 5 * 2 / (n / 2) ** 0.5) & (F.abs(F.col("s") - 2) < 5 * 2 / n**0.5)
    return uni.unionAll(zipf).unionAll(gauss.select(F.concat(F.lit("gaussian"), "centre").alias("kind"), "n", fits.alias("fits")))


def op_record_reader(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format("fragsql_records").schema("n bigint").option("reader", "fragsql.sources.records:numbers").option("splits", 4).option("rows", 25).load()


def _config_files(spark: SparkSession, d: str) -> dict[str, str]:
    """Configurations of the nodes in the catalog table, as files."""
    rows = table(spark, d, "distribution_catalog").where("distkey = ''")
    node = rows.select(F.col("node").alias("NODE"), F.coalesce("masternode", F.lit(" ")).alias("MASTER"), F.concat(F.lit("db:"), "node").alias("DBURL"), F.lit("u").alias("USER"), F.lit("").alias("PASSWORD"), F.lit("out").alias("MAPOUTPUT"))
    sinks = F.lit("/s1, /s2,/s3")
    pe = rows.select(F.concat(F.lit("pe-"), "node").alias("ID"), F.col("node").alias("NODE"), F.lit("db").alias("DBURL"), F.lit(None).cast("string").alias("USER"), F.lit(None).cast("string").alias("PASSWORD"), F.lit(7000).alias("XFER_PORT"), sinks.alias("SHUFFLE_DATASINK"))
    both = node.join(pe.select("NODE", "ID", "XFER_PORT", "SHUFFLE_DATASINK"), "NODE").select(*configs.ELEMENT_COLUMNS)
    return {name: csvio.write_csv_file(df, _path(spark, ".csv"), header=True) for name, df in (("partitions", node), ("reducers", pe), ("elements", both))}


def op_configs(spark: SparkSession, d: str) -> DataFrame:
    files = _config_files(spark, d)
    masters, reducers = configs.load_partitions(spark, files["partitions"]), configs.load_reducers(spark, files["reducers"])
    again, more = configs.load_elements(spark, files["elements"])
    rows = [("master", m.node, ",".join(sorted(s.node for s in m.slaves)), m.url) for m in masters] + [("reducer", r.node, r.id, str(r.port)) for r in reducers]
    rows += [("element master", m.node, ",".join(sorted(s.node for s in m.slaves)), m.url) for m in again] + [("element reducer", r.node, r.id, str(r.port)) for r in more]
    return _rows(spark, rows, "kind string, node string, has string, at string")


def op_least_used_sink(spark: SparkSession, d: str) -> DataFrame:
    """How often each sink of a reducer was chosen in eight turns."""
    reducers = configs.load_reducers(spark, _config_files(spark, d)["reducers"])
    for r in reducers:
        for _ in range(8):
            r.sink()
    return _rows(spark, [(r.node, s, n) for r in reducers for s, n in r.uses.items()], "node string, sink string, n int")


# -- flow language and command line ---------------------------------------------------------------------------------------


def _processor(spark: SparkSession, d: str) -> tuple[Processor, str]:
    files = _config_files(spark, d)
    load = "".join(f'LOAD {what} into catalog "c" from file "{files[f]}"; ' for what, f in (("partitions", "partitions"), ("reducers", "reducers")))
    return Processor(spark, {"access_log": table(spark, d, "access_log"), "nation": table(spark, d, "nation")}), load


def op_flow_pair(spark: SparkSession, d: str) -> DataFrame:
    flow, load = _processor(spark, d)
    script = load + """-- counts by url, spread by hash over the reducers
      map-and-shuffle { select url, count(*) as n from access_log group by url; } catalog_name = "c" num_reducers = 5 distributed by hash(url);
      /* any statements */ map { select count(*) as n from nation where n_name <> '\\}'; } catalog_name = "c";
      reduce at "pe-none" { select 1; };"""
    flow.run(script.replace('reduce at "pe-none" { select 1; };', ""))
    element = flow.module("c").reducers[0].id
    return flow.run(f'reduce at "{element}" {{ select url, sum(n) as pageview from <src> group by url; }} catalog_name = "c";')[-1][1]


def op_flow_spawn(spark: SparkSession, d: str) -> DataFrame:
    flow, _ = _processor(spark, d)
    flow.run("let $a := spawn { map { select n_regionkey as k, count(*) as n from nation group by n_regionkey; }; }; let $b := spawn { map { select 99 as k, count(*) as n from nation; }; }; sync $a, $b; sync all;")
    return flow.variables["a"].result()[0].unionAll(flow.variables["b"].result()[0].select(F.col("k").cast("int"), "n"))


def op_service_calls(spark: SparkSession, d: str) -> DataFrame:
    flow, load = _processor(spark, d)
    flow.run(load)
    calls = [("partitions", p.node) for p in flow.partitions("c")]
    calls += [("query", str(flow.execute_query("select max(n_nationkey) as m from nation").first()["m"]))]
    calls += [("deleted", str(flow.delete_catalog("c"))), ("again", str(flow.delete_catalog("c"))), ("left", str(len(flow.partitions("c"))))]
    return _rows(spark, calls, "what string, answer string")


def op_command_line(spark: SparkSession, d: str) -> DataFrame:
    """execute with a first job, into a view."""
    name = f"cli_{uuid.uuid4().hex}"
    queries = {"pre-map": "select sum(o_totalprice) as s, count(*) as n from orders", "pre-reduce": "select sum(s) / sum(n) from <src>", "map-query": "select o_orderpriority as p, count(*) as n from orders where o_totalprice > <src> group by o_orderpriority", "reduce-query": "select p, sum(n) as n from <src> group by p"}
    with tempfile.TemporaryDirectory() as folder:  # read by the driver alone
        args = []
        for option, sql in queries.items():
            (Path(folder) / option).write_text(sql)
            args += [f"--{option}", f"{folder}/{option}"]
        cli.main(["--data", d, "execute", *args, "--output-method", "VIEW", "--output-name", name, "--failover"], spark)
    return spark.table(name)


# -- functions ------------------------------------------------------------------------------------------------------------


def op_array_statistics(spark: SparkSession, d: str) -> DataFrame:
    r = lambda f: F.round(f("embedding"), 6).alias(f.__name__)
    return table(spark, d, "embeddings").select("vec_id", *map(r, (arrays.array_sum, arrays.array_mean, arrays.array_variance, arrays.array_stddev, arrays.array_least, arrays.array_most)))


def op_hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How many keys fall into each of 128 buckets by the folded FNV-1a hash."""
    keys = table(spark, d, "orders").select(hashes.fold_bucket(hashes.hash_column("fnv1a_32", F.col("o_orderkey").cast("string")).bitwiseAND(F.lit(0xFFFFFFFF)), 128).alias("bucket"))
    return keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def op_hash_families(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", *[hashes.hash_column(h, name).alias(h) for h in ("fnv1_32", "fnv1a_32", "fnv1a_64", "native", "pure_sha1", "murmur_32")])


def op_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Texts compressed and restored, and whether repeated text got shorter."""
    t = F.col("text")
    lzf, deflate = codecs.compress(F.concat(t, t, t, t), "lzf"), codecs.compress(t, "deflate")
    packed = table(spark, d, "documents").select("doc_id", "text", lzf.alias("lzf"), deflate.alias("deflate"))
    back = packed.withColumns({"a": codecs.decompress("lzf", "lzf").cast("string"), "b": codecs.decompress("deflate", "deflate").cast("string")})
    shorter = (F.octet_length("lzf") < 4 * F.octet_length("text")) | (F.octet_length("text") < 8)
    return back.select("doc_id", F.substring("a", 1, F.length("text")).alias("again"), (F.length("a") == 4 * F.length("text")).alias("whole"), F.col("b").alias("text"), shorter.alias("shorter"))


def op_formats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", text.display_bytes(F.col("o_orderkey") * 1402 + 1).alias("size"), text.format_millis(F.col("o_orderkey") * 977).alias("span"), text.to_bits("o_orderkey", 20).alias("bits"), text.escape("o_orderpriority").alias("escaped"))


def op_powers_of_two(spark: SparkSession, d: str) -> DataFrame:
    sizes = sorted({r["p_size"] for r in table(spark, d, "part").select("p_size").distinct().collect()})  # 50 different sizes
    return _rows(spark, [(n, hashes.is_power_of_two(n), hashes.next_power_of_two(n), hashes.shift_of(hashes.next_power_of_two(n))) for n in sizes], "n int, power boolean, following int, shift int")


def op_kmeans_rest(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of centroids at rest: points and labels, points nearer to another centroid, centroids off the mean of their points."""
    points = stage(table(spark, d, "embeddings").select("vec_id", "embedding"), "points")
    start = [list(map(float, r["embedding"])) for r in points.where("vec_id < 5").orderBy("vec_id").collect()]
    fit = kmeans.fit(points, "embedding", 5, start=start)
    centroids, labelled = fit[0], stage(fit[1], "labelled")
    near = F.array_min(F.array(*[kmeans.squared_distance("embedding", c) for c in centroids]))
    own = F.element_at(F.array(*[kmeans.squared_distance("embedding", c) for c in centroids]), F.col("label") + 1)
    of_points = labelled.agg(F.count(F.lit(1)).alias("points"), F.count("label").alias("labels"), F.sum((own > near).cast("bigint")).alias("wrong"))
    off = sum((x - y) ** 2 > 1e-6 for r in kmeans.means(labelled, "embedding", "label").collect() for x, y in zip(r["mean"], centroids[r["label"]], strict=True))
    return of_points.withColumns({"off": F.lit(off), "rested": F.lit(fit.converged)})


def op_sample_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a sample of one in ten: none twice, none foreign, as many as expected within six deviations."""
    orders = table(spark, d, "orders").select("o_orderkey")
    got = stage(kmeans.sample(orders, 100, 1000, seed=7), "sample")
    n = orders.count()
    foreign = got.join(orders, "o_orderkey", "left_anti").count()
    return got.agg((F.count(F.lit(1)) - F.countDistinct("o_orderkey")).alias("twice"), F.lit(foreign).alias("outside"), (F.abs(F.count(F.lit(1)) - n / 10) <= 6 * (n * 0.09) ** 0.5).alias("expected"))


_NAMED = (
    op_plain_hash, op_shard_stats, op_overlap_ratio, op_multi_key_copies, op_fragment_rows, op_average_records, op_bulk_load, op_ring_route,
    op_ring_successors, op_output_keys, op_catalog_masters, op_catalog_states, op_register_tables, op_exact_search, op_get, op_key_order, op_early_stop,
    op_add_records, op_store_commands, op_replicas, op_add_at_nodes, op_plain_layout, op_reduce_skip, op_scatter, op_gather, op_split_job,
    op_task_policies, op_database_job, op_execute_update, op_checked_append, op_header_csv, op_number_files, op_generators, op_record_reader, op_configs,
    op_least_used_sink, op_flow_pair, op_flow_spawn, op_service_calls, op_command_line, op_array_statistics, op_hash_buckets, op_hash_families, op_codecs,
    op_formats, op_powers_of_two, op_kmeans_rest, op_sample_of_rows,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMED} | {f"op_fragment_{v.value}": _variant(v) for v in fr.Variant}


def _shard(*columns: str, shards: int = SHARDS) -> str:
    """The shard of a key by SHA-1 in SQL."""
    return f"cast(cast('0x' || substr(sha1({' || chr(124) || '.join(f'cast({c} as varchar)' for c in columns)}), 1, 8) as bigint) % {shards} as integer)"


def _order_copies(shards: int) -> str:
    own = [("orders", "o_orderkey", ("o_orderkey",), 2), ("orders", "o_orderkey", ("o_custkey",), 16)]
    items = [("lineitem", "l_orderkey", cols, bit) for cols, bit in ((("l_orderkey", "l_linenumber"), 1), (("l_orderkey",), 2), (("l_partkey", "l_suppkey"), 4), (("l_partkey",), 8), (("l_suppkey",), 32))]
    each = " union all ".join(f"select {k} as o_orderkey, {_shard(*cols, shards=shards)} as _shard, {bit} as b from {t}" for t, k, cols, bit in own + items)
    return f"select o_orderkey, _shard, cast(bit_or(b) as integer) as _hidden from ({each}) group by 1, 2"


_CUSTOMER_COPIES = f"""
  with o as ({_order_copies(4)}),
  each as (select c_custkey, {_shard("c_custkey", shards=4)} as _shard, 16 as b from customer union all select c_custkey, {_shard("c_nationkey", shards=4)}, 64 from customer
    union all select o_custkey, _shard, _hidden from o join orders on o.o_orderkey = orders.o_orderkey)
  select c_custkey, _shard, cast(bit_or(b) as integer) as _hidden from each group by 1, 2"""

_PLACES = "places as (select r_name as node, substr(sha1(r_name || '#' || i), 1, 16) as p from region, range(16) t(i))"


def _fnv(c: str, bits: int, xor_first: bool = True) -> str:
    start, prime = ("2166136261", "16777619") if bits == 32 else ("14695981039346656037", "1099511628211")
    step = f"(xor(h, b) * {prime}) % {1 << bits}" if xor_first else f"xor((h * {prime}) % {1 << bits}, b)"
    return f"list_reduce([{start}::hugeint] || list_transform(range(1, length({c}) + 1), lambda i: ascii(substr({c}, i, 1))::hugeint), lambda h, b: {step})"


def _signed(h: str, bits: int) -> str:
    return f"cast(case when {h} >= {1 << bits - 1} then {h} - {1 << bits} else {h} end as bigint)"


_BASES = {"lineitem": ("lineitem", ("l_orderkey", "l_linenumber")), "orders": ("orders", ("o_orderkey",)), "partsupp": ("(select distinct l_partkey as ps_partkey, l_suppkey as ps_suppkey from lineitem)", ("ps_partkey", "ps_suppkey")), "part": ("part", ("p_partkey",)), "customer": ("customer", ("c_custkey",)), "supplier": ("supplier", ("s_suppkey",)), "nation": ("nation", ("n_nationkey",)), "region": ("region", ("r_regionkey",))}


def _average(name: str) -> str:
    base, pk = _BASES[name]
    sizes = f"select s, count(k) as n from range({SHARDS}) t(s) left join (select {_shard(*pk)} as k from {base}) on s = k group by s"
    return f"select '{name}' as name, round(avg(n), 6) as average, round(stddev(n), 6) as deviation from ({sizes})"


_VIEWS = "select url, count(*) as pageview from access_log group by url"
_SIZES8 = f"select s, count(k) as n from range(8) t(s) left join (select {_shard('l_orderkey', shards=8)} as k from lineitem) on s = k group by s"
_THREE = "list_value({})".format(", ".join(_shard(c, shards=4) for c in ("l_orderkey", "l_partkey", "l_suppkey")))
_MASTERS = "select node, masternode from distribution_catalog where distkey = ''"
_HAS = f"select m.node, coalesce(string_agg(s.node, ',' order by s.node), '') as has from ({_MASTERS}) m left join ({_MASTERS}) s on s.masternode = m.node where m.masternode is null group by 1"
_MURMUR = """(with recursive w(c_custkey, s, i, h) as (
    select c_custkey, c_name, 1, xor(3735928559::hugeint, length(c_name)::hugeint) from customer
    union all
    select c_custkey, s, i + 4, xor((h * 1540483477) % 4294967296, (xor(k2, k2 // 16777216) * 1540483477) % 4294967296)
    from (select *, (((ascii(substr(s, i, 1)) + 256 * ascii(substr(s, i + 1, 1)) + 65536 * ascii(substr(s, i + 2, 1)))::hugeint + 16777216 * ascii(substr(s, i + 3, 1))::hugeint) * 1540483477) % 4294967296 as k2 from w where i + 3 <= length(s))),
  t as (select c_custkey, s, i, h from w where i + 3 > length(s)),
  u as (select c_custkey, case when i > length(s) then h else (xor(h, list_sum(list_transform(range(0, length(s) - i + 1), lambda j: ascii(substr(s, (i + j)::bigint, 1))::hugeint * (256 ** j)::hugeint))::hugeint) * 1540483477) % 4294967296 end as h from t),
  v as (select c_custkey, (xor(h, h // 8192) * 1540483477) % 4294967296 as h from u)
  select c_custkey, xor(h, h // 32768) as h from v)"""

SQL: dict[str, str] = {
    "op_plain_hash": f"select o_orderkey, {_shard('o_orderkey', shards=8)} as _shard from orders",
    "op_shard_stats": f"""select cast(sum(n) as bigint) as total, max(n) as most, min(n) as least, cast(floor(avg(n)) as bigint) as mean, round(stddev_samp(n), 6) as stddev,
      round(stddev_samp(n) * 100 / floor(avg(n)), 6) as percent from ({_SIZES8})""",
    "op_overlap_ratio": f"select n_keys, n_copies, round((n_keys - n_copies) / n_keys::double, 9) as overlap from (select 3 * count(*) as n_keys, cast(sum(len(list_distinct({_THREE}))) as bigint) as n_copies from lineitem)",
    "op_multi_key_copies": f"select distinct o_orderkey, o_custkey, unnest([{_shard('o_orderkey', shards=4)}, {_shard('o_custkey', shards=4)}]) as _shard from orders",
    "op_fragment_rows": _order_copies(SHARDS),
    **{f"op_fragment_{v.value}": _CUSTOMER_COPIES for v in fr.Variant},
    "op_average_records": " union all ".join(_average(t) for t in _BASES),
    "op_bulk_load": f"select c_custkey, c_name from customer where {_shard('c_custkey')} = 1",
    "op_ring_route": f"with {_PLACES}, k as (select c_custkey, substr(sha1(c_name), 1, 16) as h from customer) select c_custkey, coalesce(node, (select node from places order by p limit 1)) as node from k asof left join places on k.h < places.p",
    "op_ring_successors": f"""with {_PLACES}, k as (select p_partkey, substr(sha1(p_name), 1, 16) as h from part),
      near as (select p_partkey, node, min(case when p > h then '0' else '1' end || p) as far from k, places group by 1, 2),
      first as (select *, row_number() over (partition by p_partkey order by far) as r from near)
      select p_partkey, string_agg(node, ',' order by far) as nodes from first where r <= 3 group by 1""",
    "op_output_keys": f"with {_PLACES}, k as (select o_custkey, count(*) as n, substr(sha1(cast(o_custkey as varchar)), 1, 16) as h from orders group by 1) select o_custkey, coalesce(node, (select node from places order by p limit 1)) as node, n from k asof left join places on k.h < places.p",
    "op_catalog_masters": """select m.distkey, m.node, count(s.node) as slaves from distribution_catalog m left join distribution_catalog s
      on s.distkey = m.distkey and s.masternode = m.node where m.masternode is null group by 1, 2""",
    "op_catalog_states": "select node, masternode, cast(case when masternode is null then 1 when state in (0, 1, -1, -2) then state else -2 end as integer) as state, masternode is null as changed from distribution_catalog where distkey = ''",
    "op_register_tables": """select * from (values ('lineitem', 1, 1), ('lineitem', 1, 2), ('lineitem', 1, 8), ('lineitem', 1, 32), ('orders', 2, 2), ('orders', 2, 16),
      ('partsupp', 3, 4), ('partsupp', 3, 8), ('partsupp', 3, 32), ('part', 4, 8), ('customer', 5, 16), ('customer', 5, 64), ('supplier', 6, 32), ('supplier', 6, 64), ('nation', 7, 64), ('nation', 7, 128), ('region', 8, 128)) t(tablename, id, bit)""",
    "op_exact_search": "select o_orderkey from orders where o_custkey = 22",
    "op_get": "select cast(c_custkey as varchar) as k, c_name as v from customer where c_custkey in (1, 70)",
    "op_key_order": "select k, row_number() over (order by k) as place from (select cast(o_orderkey as varchar) as k from orders)",
    "op_early_stop": "select k from (select cast(o_orderkey as varchar) as k from orders) where k > '3' order by k limit 25",
    "op_add_records": "select * from customer",
    "op_store_commands": """select * from (values ('create', 'True'), ('again', 'False'), ('names', 'a,b'), ('getq', 'silence'), ('getk', 'not found||'), ('setq', 'silence'), ('set', 'ok||'), ('getkq', 'ok|5|five'),
      ('quitq', 'silence'), ('left', 'b'), ('purged', '')) t(command, answer)
      union all select 'get', 'ok||' || n_name from nation where n_nationkey = 3 union all select 'GETK', 'ok|4|' || n_name from nation where n_nationkey = 4 union all select 'rows', cast(count(*) as varchar) from nation""",
    "op_replicas": f"""with {_PLACES}, k as (select c_custkey, substr(sha1(c_name), 1, 16) as h from customer),
      near as (select c_custkey, node, min(case when p > h then '0' else '1' end || p) as far from k, places group by 1, 2),
      placed as (select *, row_number() over (partition by c_custkey order by far) as r from near)
      select 'all' as node, count(*) as n, cast(sum(c_custkey) as bigint) as keys from customer
      union all select node, count(*), cast(sum(c_custkey) as bigint) from placed where r <= 2 group by 1""",
    "op_add_at_nodes": "select reader, case when reader = 'lost' then 0 else n end as n from (select count(*) as n from supplier), (values ('first'), ('second'), ('lost'), ('mapped')) t(reader)",
    "op_plain_layout": "select k from (select cast(o_orderkey as varchar) as k from orders) where k between '10' and '20'",
    "op_reduce_skip": "select o_custkey, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from orders where o_orderkey % 4 <> 0 group by 1",
    "op_scatter": _VIEWS,
    "op_gather": _VIEWS,
    "op_split_job": "select n_name as item, length(n_name) as result from nation union all select 'all', cast(sum(length(n_name)) as bigint) from nation",
    "op_task_policies": """select policy, n_nationkey as k, cast(n_nationkey * n_nationkey as bigint) as result from nation, (values ('skip', 1000), ('return', 12), ('cancel', 11)) t(policy, upto)
      where n_nationkey % 5 <> 3 and n_nationkey <= upto""",
    "op_database_job": "select o_orderpriority as p, count(*) as n from orders group by 1",
    "op_execute_update": """select 'create' as statement, 0 as n union all select 'insert', cast(count(*) as integer) from nation where n_regionkey = 1
      union all select 'delete', cast(count(*) as integer) from nation where n_regionkey = 1 and n_nationkey > 10""",
    "op_checked_append": "select s_suppkey, s_nationkey, true as told from supplier",
    "op_header_csv": "select doc_id as DOC_ID, text as TEXT, source as SOURCE from documents",
    "op_number_files": "select cast(i - 1 as integer) as place, count(*) as n, round(avg(embedding[i]::double), 9) as m from embeddings, range(1, 65) t(i) group by 1",
    "op_generators": "select kind, cast(n as bigint) as n, fits from (values ('uniform', 20000, true), ('zipf', 20000, true), ('gaussian0', 10000, true), ('gaussian1', 10000, true)) t(kind, n, fits)",
    "op_record_reader": "select range as n from range(100)",
    "op_configs": f"""select kind || 'master' as kind, node, has, 'db:' || node as at from ({_HAS}), (values (''), ('element ')) t(kind)
      union all select kind || 'reducer', node, 'pe-' || node, '7000' from ({_MASTERS}), (values (''), ('element ')) t(kind)""",
    "op_least_used_sink": f"select node, sink, n from ({_MASTERS}), (values ('/s1', 3), ('/s2', 3), ('/s3', 2)) t(sink, n)",
    "op_flow_pair": _VIEWS,
    "op_flow_spawn": "select n_regionkey as k, count(*) as n from nation group by 1 union all select 99, count(*) from nation",
    "op_service_calls": f"""select 'partitions' as what, node as answer from ({_MASTERS}) where masternode is null union all select 'query', cast(max(n_nationkey) as varchar) from nation
      union all select * from (values ('deleted', 'True'), ('again', 'False'), ('left', '0'))""",
    "op_command_line": "select o_orderpriority as p, count(*) as n from orders where o_totalprice > (select avg(o_totalprice) from orders) group by 1",
    "op_array_statistics": """with d as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select vec_id, v, list_sum(v) / len(v) as m from d),
      q as (select vec_id, v, m, list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / (len(v) - 1) as var from s)
      select vec_id, round(list_sum(v), 6) as array_sum, round(m, 6) as array_mean, round(var, 6) as array_variance, round(sqrt(var), 6) as array_stddev, round(list_min(v), 6) as array_least, round(list_max(v), 6) as array_most from q""",
    "op_hash_buckets": f"with h as (select cast({_fnv('k', 32)} as bigint) as h from (select cast(o_orderkey as varchar) as k from orders)) select xor(h >> 7, h) & 127 as bucket, count(*) as n from h group by 1",
    "op_hash_families": f"""with f as (select c_custkey, {_fnv('c_name', 32, False)} as a, {_fnv('c_name', 32)} as b, {_fnv('c_name', 64)} as c,
        list_reduce([0::hugeint] || list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::hugeint), lambda h, b: (h * 31 + b) % 4294967296) as e,
        cast('0x' || substr(sha1(c_name), 1, 8) as bigint) as pure_sha1 from customer)
      select f.c_custkey, {_signed('a', 32)} as fnv1_32, {_signed('b', 32)} as fnv1a_32, {_signed('c', 64)} as fnv1a_64, {_signed('e', 32)} as native, pure_sha1, {_signed('m.h', 32)} as murmur_32
      from f join {_MURMUR} m on f.c_custkey = m.c_custkey""",
    "op_codecs": "select doc_id, text as again, case when text is not null then true end as whole, text, case when text is not null then true end as shorter from documents",
    "op_formats": """select o_orderkey, case when n < 1024 then n || ' bytes' when n < 1048576 then printf('%.2f kB', n / 1024.0) when n < 1073741824 then printf('%.2f MB', n / 1048576.0) else printf('%.2f GB', n / 1073741824.0) end as size,
      case when t = 0 then '0ms' else '' end || case when t >= 3600000 then (t // 3600000) || 'h ' else '' end || case when t % 3600000 >= 60000 then (t % 3600000 // 60000) || 'm ' else '' end || case when t % 60000 >= 1000 then (t % 60000 // 1000) || 's ' else '' end || case when t % 1000 > 0 then (t % 1000) || 'ms' else '' end as span,
      lpad(bin(o_orderkey), 20, '0') as bits, o_orderpriority as escaped from (select *, o_orderkey * 1402 + 1 as n, o_orderkey * 977 as t from orders)""",
    "op_powers_of_two": "select distinct p_size as n, bit_count(p_size) = 1 as power, cast(pow(2, ceil(log2(p_size))) as integer) as following, cast(ceil(log2(p_size)) as integer) as shift from part",
    "op_kmeans_rest": "select count(*) as points, count(*) as labels, cast(0 as bigint) as wrong, 0 as off, true as rested from embeddings",
    "op_sample_of_rows": "select cast(0 as bigint) as twice, 0 as outside, true as expected",
}
