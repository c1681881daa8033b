"""Scripts, dialect, key annotation, two-phase execution, fragments and the catalog."""

import random
from types import SimpleNamespace

import pytest
from conftest import same
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragsql.operators import fragment as fr
from fragsql.operators.catalog import HIDDEN, SHARD, Catalog, NodeState, TableSpec
from fragsql.plans.dialect import normalise
from fragsql.plans.keyed import rewrite
from fragsql.plans.script import first_select, index_of_select, split_script, tokens, validate_script
from fragsql.plans.twophase import Output, execute
from fragsql.queries import ops, parts, tpch
from fragsql.runtime import bounded_broadcast, release_staged, shared_dir, stage, staging

# -- scripts ----------------------------------------------------------------------------------------------------------


def test_split():
    assert split_script("create view v as select 1; select * from v;\n drop view v;") == ["create view v as select 1", "select * from v", "drop view v"]
    assert split_script("select ';' , \"a;b\", `c;` -- ; no\n/* ; */ from t; select 2") == ["select ';' , \"a;b\", `c;` -- ; no\n/* ; */ from t", "select 2"]
    assert split_script("select 1;") == ["select 1;"]
    assert split_script("  ;; -- only this\n") == []
    assert split_script("select 'it''s; fine'; select 'open; end") == ["select 'it''s; fine'", "select 'open; end"]


@given(st.text(alphabet="ab ;'\"`-/*\n.", max_size=30))
def test_pieces_join_to_the_text(sql):
    assert "".join(text for _, text in tokens(sql)) == sql
    assert "".join(split_script(sql)).replace(";", "").replace(" ", "").count("a") <= sql.count("a")


def test_validate():
    before, query, after = validate_script("/* x */ create view v as select 1; -- note\n select * from v ; drop view v")
    assert before == ["/* x */ create view v as select 1"] and query.endswith("select * from v") and after == ["drop view v"]
    assert validate_script("with a as (select 1) select * from a;")[1] == "with a as (select 1) select * from a"
    for bad in ("drop view v", "", "select 1; select 2", "insert into t values (1); select 1"):
        with pytest.raises(ValueError):
            validate_script(bad)
    assert index_of_select(["drop view v", "SELECT 1", "select 2"]) == 1 and first_select(["drop x"]) is None


def test_dialect():
    assert normalise("date '1998-12-01' - interval '90' day (3)") == "date '1998-12-01' - interval '90' day"
    assert normalise("interval '1' month ( 2 ) + x") == "interval '1' month + x"
    assert normalise("select day (d), 'day (3)' from t") == "select day (d), 'day (3)' from t"
    assert normalise('select "a b", "q""x" from "t" where s = \'"\'') == "select `a b`, `q\"x` from `t` where s = '\"'"
    assert normalise(" CREATE VIEW v (a) as select 1").strip() == "create or replace temporary view v (a) as select 1"


def test_rewrite():
    c = tpch.catalog()
    assert [c.bit(s.name) for s in tpch.SPECS] == [1, 2, 4, 8, 16, 32, 64, 128]
    assert rewrite("select 1 from lineitem where lineitem partitioned by (primarykey) and x", c) == "select 1 from lineitem where ((lineitem._hidden & 1) = 1) and x"
    assert rewrite("orders PARTITIONED BY (o_orderkey)", c) == "((orders._hidden & 2) = 2)"
    assert rewrite("lineitem Partitioned By ( l_partkey , l_suppkey,l_orderkey ) or y", c) == "((lineitem._hidden & 42) <> 0) or y"
    assert rewrite("nation partitioned by (n_nationkey, n_regionkey) alias n1 and z", c) == "((n1._hidden & 192) <> 0) and z"
    assert rewrite("select 'lineitem partitioned by (x)' -- partitioned by\n from t", c) == "select 'lineitem partitioned by (x)' -- partitioned by\n from t"
    assert rewrite("select partitioned from t", c) == "select partitioned from t"
    for bad in ("lineitem partitioned by (l_tax)", "partitioned by (primarykey)", "orders partitioned by primarykey", "orders partitioned by (o_orderkey"):
        with pytest.raises(ValueError):
            rewrite(bad, c)
    with pytest.raises(KeyError):
        rewrite("unknown partitioned by (primarykey)", c)


# -- catalog ----------------------------------------------------------------------------------------------------------


def test_catalog():
    c = Catalog()
    a, b = TableSpec("A", ("x",), ((("y",), "B"),)), TableSpec("B", ("y",))
    assert c.register([a, b]) == [1, 2] and c.register([b]) == [2] and c.bit("b") == 2
    assert c.load_order() == ["A", "B"] and c.referencing("B") == [(a, ("y",))]
    with pytest.raises(KeyError):
        c.bit("none")
    with pytest.raises(ValueError):
        c.register([TableSpec(f"t{i}", ("x",)) for i in range(30)])
    loop = Catalog()
    loop.register([TableSpec("p", ("x",), ((("y",), "q"),)), TableSpec("q", ("y",), ((("x",), "p"),))])
    with pytest.raises(ValueError):
        loop.load_order()
    c.add_node("n1")
    c.add_node("n2", "n1")
    c.add_node("n3", distkey="k")
    assert c.masters() == ["n1"] and c.slaves("n1") == ["n2"] and c.masters("k") == ["n3"]
    assert c.set_state("n1", NodeState.DEAD) is NodeState.NORMAL and c.set_state("n1", NodeState.NORMAL) is NodeState.DEAD
    assert NodeState.MAINTENANCE.valid and not NodeState(-2).valid


def test_catalog_from_and_to_tables(spark, data):
    rows = spark.read.parquet(f"{data}/distribution_catalog.parquet")
    c = tpch.catalog()
    c.load_nodes(rows)
    nodes, ids = c.tables(spark)
    assert sorted(nodes.drop("state").collect()) == sorted(rows.select("distkey", "node", "masternode").collect())
    assert {r["tablename"]: r["id"] for r in ids.collect()}["partsupp"] == 3
    for key in {r["distkey"] for r in rows.collect()}:
        listed = set(c.masters(key)) | {s for m in {r["masternode"] for r in rows.where(F.col("distkey") == key).collect() if r["masternode"]} for s in c.slaves(m, key)}
        assert listed == {r["node"] for r in rows.where(F.col("distkey") == key).collect()}


# -- fragments --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_fragments_of_a_small_schema(spark, shards):
    c = Catalog()
    c.register([TableSpec("item", ("i",), ((("o",), "ord"), (("p",), "prod"))), TableSpec("ord", ("o",), ((("c",), "cust"),)), TableSpec("prod", ("p",)), TableSpec("cust", ("c",))])
    rnd = random.Random(shards)
    items = [(i, rnd.choice([None, *range(20)]), rnd.choice([0] * 5 + list(range(8)))) for i in range(200)] + [(5, 1, 1)]
    tables = {
        "item": spark.createDataFrame(items, "i int, o int, p long"),
        "ord": spark.createDataFrame([(o, rnd.choice([None, 1, 2, 3])) for o in range(25)], "o int, c int"),
        "prod": spark.createDataFrame([(p, f"p{p}") for p in range(9)], "p int, name string"),
        "cust": spark.createDataFrame([(k,) for k in range(5)], "c int"),
    }
    got = fr.fragment_all(tables, c, shards)
    for name, df in got.items():
        base = sorted(map(repr, tables[name].collect()))
        assert sorted(map(repr, fr.family(df, c.bit(name)).drop(SHARD, HIDDEN).collect())) == base
        assert df.where(f"{HIDDEN} = 0 or {SHARD} < 0 or {SHARD} >= {shards}").count() == 0
        for cols, to in c.spec(name).fks:
            placed = fr.family(df, c.bit(to))
            kept = tables[name].where(F.col(cols[0]).isNotNull())
            assert sorted(map(repr, placed.drop(SHARD, HIDDEN).collect())) == sorted(map(repr, kept.collect()))
            # every copy finds the row it refers to in its own shard
            other = got[to].select(F.col(SHARD).alias("s2"), F.col(cols[0]).alias("k2"))
            lost = df.where(F.col(cols[0]).isNotNull()).join(other, (F.col(SHARD) == F.col("s2")) & (F.col(cols[0]) == F.col("k2")), "left_anti")
            assert lost.count() == 0
    assert got["item"].count() >= len(items)


def test_fragment_needs_referencing_tables_first(spark):
    c = Catalog()
    c.register([TableSpec("a", ("x",), ((("y",), "b"),)), TableSpec("b", ("y",))])
    b = spark.createDataFrame([(1,)], "y int")
    with pytest.raises(ValueError):
        fr.fragment(b, c.spec("b"), c, 2)
    a = spark.createDataFrame([], "x int, y int")
    assert fr.fragment(a, c.spec("a"), c, 2).count() == 0
    assert fr.fragment(b, c.spec("b"), c, 2, {"a": fr.fragment(a, c.spec("a"), c, 2)}).count() == 1


def test_saved_fragments_are_pruned(spark, data, tmp_path):
    parts = tpch.fragments(spark, data)
    fr.save_fragments(parts["orders"], str(tmp_path / "orders"))
    with pytest.raises(ValueError):
        fr.save_fragments(parts["nation"], str(tmp_path / "nation"), expected=1)
    back = spark.read.parquet(str(tmp_path / "orders"))
    assert back.count() == parts["orders"].count()
    plan = back.where(f"{SHARD} = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_shard" in plan


@pytest.mark.parametrize("shards", [2, 5])
def test_table_that_refers_to_itself(spark, shards):
    c = Catalog()
    c.register([TableSpec("emp", ("id",), ((("boss",), "emp"), (("dept",), "dept"))), TableSpec("dept", ("dept",))])
    rnd = random.Random(shards)
    rows = [(i, rnd.choice([None, rnd.randrange(i), i // 2]) if i else None, rnd.choice([None, 1, 2, 3])) for i in range(60)] + [(7, 3, 1), (70, 70, 2)]
    emp = spark.createDataFrame(rows, "id int, boss int, dept int")
    got = fr.fragment_all({"emp": emp, "dept": spark.createDataFrame([(1,), (2,), (3,)], "dept int")}, c, shards)["emp"]
    plain = lambda df: sorted(map(repr, df.drop(SHARD, HIDDEN).collect()))
    assert plain(fr.family(got, c.bit("emp"))) == plain(emp)
    assert plain(fr.family(got, c.bits_of("emp", ["boss"])[0])) == plain(emp.where("boss is not null"))
    assert plain(fr.family(got, c.bits_of("emp", ["dept"])[0])) == plain(emp.where("dept is not null"))
    # the boss of every copy, and that one's boss, are in the same shard
    boss = got.select(F.col(SHARD).alias("s2"), F.col("id").alias("k2"))
    assert got.where("boss is not null").join(boss, (F.col(SHARD) == F.col("s2")) & (F.col("boss") == F.col("k2")), "left_anti").count() == 0
    assert fr.fragment(emp.where("false"), c.spec("emp"), c, shards).count() == 0
    assert dict(c.tables(spark)[1].collect())["emp@self"] == 2


@pytest.mark.parametrize("variant", list(fr.Variant))
def test_variants_give_the_same_fragments(spark, variant):
    c = Catalog()
    c.register([TableSpec("ord", ("o",), ((("c",), "cust"),)), TableSpec("cust", ("c",))])
    orders = spark.createDataFrame([(o, o % 7 if o % 5 else None) for o in range(80)], "o int, c int")
    customers = spark.createDataFrame([(k,) for k in range(9)], "c int")
    loaded = {"ord": fr.fragment(orders, c.spec("ord"), c, 3)}
    want = fr.fragment(customers, c.spec("cust"), c, 3, loaded)
    source = [customers.where("c < 4"), customers.where("c >= 4")] if variant is fr.Variant.MULTI_GRACE else customers
    got = fr.fragment(source, c.spec("cust"), c, 3, loaded, variant=variant, buckets=4)
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    hints = {"dist": "shuffle_hash", "distmm": "broadcast", "grace": "merge", "pgrace": "shuffle_hash", "mpgrace": "shuffle_hash"}
    assert variant is fr.Variant.NORMAL or f"strategy={hints[variant.value]}" in plan
    assert ("RepartitionByExpression" in plan) == ("grace" in variant.value)
    with pytest.raises(ValueError):
        fr.fragment(customers, c.spec("cust"), c, 3, loaded, buckets=3)


def test_many_shards_are_planned_one_by_one_and_read_once(spark, data):
    parts = tpch.fragments(spark, data, 20)
    spark.range(3).createOrReplaceTempView("orders")  # the caller's own view of that name
    sql = "select o_orderstatus as s, count(*) as n from orders where orders partitioned by (primarykey) group by o_orderstatus"
    out = execute(spark, sql, "select s, sum(n) as n from <src> group by s", parts, 20, tpch.catalog()).value
    assert {r["s"]: r["n"] for r in out.collect()} == {r["o_orderstatus"]: r["count"] for r in tpch.tables(spark, data)["orders"].groupBy("o_orderstatus").count().collect()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")
    shard = parts["orders"].where(F.col(SHARD) == 4)
    assert "PartitionFilters: [isnotnull(_shard" in shard._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.isTemporary and t.name in parts]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default: default)

    fake = SimpleNamespace(conf=Conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)


def test_staging_ends_with_its_block(spark):
    with staging():
        df = stage(spark.range(5))
        assert df.count() == 5
    with pytest.raises(Exception, match="[Nn]ot.exist|NOT_FOUND|FAILED_READ_FILE"):
        df.collect()


def test_variants():
    assert fr.Variant.of("GRACE") is fr.Variant.GRACE and fr.Variant.of("distributed") is fr.Variant.DISTRIBUTED and fr.Variant.of("MPgrace") is fr.Variant.MULTI_GRACE
    with pytest.raises(ValueError):
        fr.Variant.of("none")


def test_staged_tables_can_be_released(spark, data):
    one = stage(spark.range(5))
    first = tpch.fragments(spark, data)
    assert one.count() == 5 and tpch.fragments(spark, data) is first
    release_staged()
    with pytest.raises(Exception, match="[Nn]ot.exist|NOT_FOUND|FAILED_READ_FILE"):
        one.collect()
    assert tpch.fragments(spark, data)["region"].count() > 0


def test_broadcast_is_size_checked(spark):
    small, large = stage(spark.range(5)), stage(spark.range(50).withColumnRenamed("id", "k"))
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "Hint" in plan(bounded_broadcast(small, 5)) and "Hint" not in plan(bounded_broadcast(large, 5))
    wide = stage(spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("t")))
    assert "Hint" in plan(bounded_broadcast(wide)) and "Hint" not in plan(bounded_broadcast(wide, size=2000))


def test_shard_stats(spark):
    df = spark.createDataFrame([(0,)] * 4 + [(1,)] * 3, f"{SHARD} int")
    r = fr.shard_stats(df, 3).first()
    assert (r["total"], r["most"], r["least"], r["mean"]) == (7, 4, 0, 2) and r["stddev"] == pytest.approx(2.0817, abs=1e-3)
    assert fr.shard_stats(df.where("false"), 2).first()["percent"] == 0


# -- two-phase --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(tpch.PAIRS))
def test_query_in_shards_and_whole(spark, data, duck, name):
    want = tpch.SQL[name]
    same(tpch.QUERIES[name](spark, data), duck, want)
    for shards in (1, 3):
        same(tpch.two_phase(name, shards)(spark, data), duck, want)


def test_average_of_averages_is_wrong_so_pairs_must_be_run_in_shards(spark, data):
    parts = tpch.fragments(spark, data)
    good = execute(spark, "select sum(l_quantity) s, count(*) n from lineitem where lineitem partitioned by (primarykey)", "select sum(s) / sum(n) from <src>", parts, 3, tpch.catalog(), output="scalarString").value
    whole = spark.read.parquet(f"{data}/lineitem.parquet").agg(F.avg("l_quantity")).first()[0]
    assert float(good.rstrip("d")) == pytest.approx(whole)


def test_outputs(spark, tmp_path):
    t = {"t": spark.createDataFrame([(1, 'say "x"', None), (2, "", 2.5)], "a int, b string, c double")}
    run = lambda out, **kw: execute(spark, "select * from t", "select * from <src> order by a", t, output=out, **kw).value
    path = run("csvFile", name=str(tmp_path / "o.csv"))
    assert open(path).read() == '1,"say ""x""",\n2,"",2.5\n'
    assert run("scalarString") == "1" and [r["a"] for r in run("frame").collect()] == [1, 2]
    assert spark.table(run("VIEW", name="two_phase_view")).count() == 2
    assert spark.table(run("Table", name="two_phase_table")).count() == 2
    spark.sql("drop table two_phase_table")
    assert execute(spark, "select * from t where false", "select a from <src>", t, output="scalarstring").value is None
    assert Output.of("CSV") is Output.CSV
    with pytest.raises(ValueError):
        Output.of("xml")


def test_first_job_fills_the_first_place(spark):
    t = {"t": spark.createDataFrame([(1,), (5,), (9,)], "a int")}
    res = execute(spark, "select a, '<src>' as s from t where a > <src>".replace("'<src>' as s", "1 as s"), "select count(*) n from <src>", t, pre_map="select avg(a) m from t", pre_reduce="select max(m) from <src>")
    assert res.value.first()["n"] == 1 and "pre" in res.seconds
    with pytest.raises(ValueError):
        execute(spark, "select a from t", "select * from <src>", t, pre_map="select 1", pre_reduce="select * from <src>")


@pytest.mark.parametrize("name", sorted(ops.SQL | parts.SQL))
def test_operator_against_sql(spark, data, duck, name):
    same((ops.QUERIES | parts.QUERIES)[name](spark, data), duck, (ops.SQL | parts.SQL)[name])


def test_multi_get_collects_no_key_whole(spark, data):
    plan = ops.QUERIES["op_multi_get"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_count" in plan


@pytest.mark.parametrize("op", ["bw", "in", "not_start_with"])
def test_index_queries_scan_a_stored_index(spark, data, op):
    files = ops.QUERIES[f"op_index_{op}"](spark, data).inputFiles()
    assert files and all("/fragsql-kv-" in f for f in files)
