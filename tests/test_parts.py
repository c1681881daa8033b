"""Key-value store, map-reduce, k-means, text in and out, functions, flow language, command line, streams, entry."""

import ast
import math
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragsql.functions import arrays, codecs, hashes, text
from fragsql.operators import jobs, kmeans, mapreduce
from fragsql.operators.kv import KVStore, predicate
from fragsql.operators.ring import Ring
from fragsql.plans import cli, flow
from fragsql.plans.twophase import map_phase
from fragsql.sources import configs, csvio, generators
from fragsql.sources.records import RecordSource
from fragsql.streaming.counts import partial_counts, total_counts, windowed_counts

# -- key-value store --------------------------------------------------------------------------------------------------


def test_store(spark, tmp_path):
    kv = KVStore(spark, str(tmp_path / "kv"))
    assert kv.create("i") and not kv.create("i") and kv.names() == ["i"]
    kv.add("i", [("b", "1"), ("a", "2"), ("b", "3")])
    kv.add("i", {"b": "4", "ab": "5"})
    assert kv.get("i", "b") == [b"1", b"3", b"4"] and kv.get("i", "none") == []
    assert [bytes(r["key"]) for r in kv.scan("i").collect()] == [b"a", b"ab", b"b", b"b", b"b"]
    assert [bytes(r["value"]) for r in kv.prefix_search("i", "a").collect()] == [b"2", b"5"]
    assert {bytes(r["key"]): [bytes(v) for v in r["values"]] for r in kv.multi_get("i", ["b", "a", "zz"]).collect()} == {b"a": [b"2"], b"b": [b"1", b"3", b"4"]}
    kv.put("i", [("b", "x"), ("b", "y"), ("c", "z")])
    assert kv.get("i", "b") == [b"y"] and kv.get("i", "a") == [b"2"] and kv.get("i", "c") == [b"z"]
    assert kv.remove("i", "b", "c") and not kv.remove("i", "a", "none") and not kv.remove("nothing", "a")
    assert [bytes(r["key"]) for r in kv.scan("i").collect()] == [b"ab"]
    kv.handle_set("i", "k", "v")
    assert kv.handle_get("i", "k") == b"v" and kv.handle_get("i", "q") is None
    kv.sync("i")
    assert kv.table("i").count() == 2 and kv.table("none").count() == 0
    kv.purge_all(True)
    assert kv.names() == []


def test_records_in_a_store(spark, tmp_path):
    kv = KVStore(spark, str(tmp_path / "kv"))
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "a int, b string, c double")
    kv.add_records("r", df, ["a", "b"])
    assert {bytes(r["key"]) for r in kv.table("r").collect()} == {b"1|x", b"2"}
    assert sorted(kv.records("r", "a int, b string, c double").collect()) == sorted(df.collect())


def test_ring(spark):
    ring = Ring(["a", "b", "c", "d"])
    keys = [f"k{i}" for i in range(4000)]
    sizes = Counter(map(ring.node, keys))
    assert len(sizes) == 4 and hashes.load_balance(list(sizes.values())) < 25
    fewer = Ring(["a", "b", "c"])
    assert all(ring.node(k) == fewer.node(k) for k in keys if ring.node(k) != "d")
    assert ring.successors("k", 3)[0] == ring.node("k") and len(set(ring.successors("k", 9))) == 4 and len(ring.successors("k", 9, physical=False)) == 9
    got = spark.createDataFrame([("k1",), (None,)], "k string").select(ring.column("k").alias("n")).collect()
    assert [r["n"] for r in got] == [ring.node("k1"), None]
    with pytest.raises(ValueError):
        Ring([])


def test_record_source(spark):
    spark.dataSource.register(RecordSource)
    df = spark.read.format("fragsql_records").schema("n long").option("reader", "fragsql.sources.records:numbers").option("splits", 3).option("rows", 4).load()
    assert sorted(r["n"] for r in df.collect()) == list(range(12)) and df.rdd.getNumPartitions() == 3


def test_predicates(spark):
    keys = [b"", b"a", b"ab", b"b", b"\x7f", b"\x80", b"\xff", b"\xff\xff"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    got = lambda op, *a: [bytes(r["key"]) for r in df.where(predicate(op, *a)).collect()]
    rules = {
        "eq": (lambda k, a: k == a, 1), "ne": (lambda k, a: k != a, 1), "gt": (lambda k, a: k > a, 1), "ge": (lambda k, a: k >= a, 1),
        "lt": (lambda k, a: k < a, 1), "le": (lambda k, a: k <= a, 1), "bw": (lambda k, a, b: a <= k <= b, 2), "bwx": (lambda k, a, b: a < k < b, 2),
        "nbw": (lambda k, a, b: k <= a or k >= b, 2), "nbwx": (lambda k, a, b: k < a or k > b, 2), "start_with": (lambda k, a: k.startswith(a), 1),
        "not_start_with": (lambda k, a: not k.startswith(a), 1),
    }
    for op, (rule, n) in rules.items():
        for args in ((b"a", b"b"), (b"ab", b"\x80"), (b"\xff", b"\xff")):
            assert got(op, *args[:n]) == [k for k in keys if rule(k, *args[:n])], (op, args)
    assert got("in", "a", b"\x80") == [b"a", b"\x80"] and got("in") == [] and got("not_in") == keys and got("any") == keys
    with pytest.raises(ValueError):
        predicate("bw", "a")
    with pytest.raises(ValueError):
        predicate("like", "a")


# -- map-reduce -------------------------------------------------------------------------------------------------------


def test_map_reduce_sum_equals_total(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 9 + list("abc")),) for _ in range(5000)]
    df = spark.createDataFrame(rows, "url string").repartition(3)
    add = lambda k, values: [(k, sum(values))]
    for combiner in (None, add):
        out = mapreduce.map_reduce(df, lambda u: [(u, 1)], "url string, n long", add, "url string, pageview long", combiner)
        got = {r["url"]: r["pageview"] for r in out.collect()}
        assert got == Counter(u for (u,) in rows) and sum(got.values()) == 5000
    mapped = mapreduce.map_phase(df, lambda u: [(u, 1)], "url string, n long", combiner=add)
    assert mapped.count() < 50  # the combiner saw nearly all
    small = mapreduce.map_phase(df.limit(100), lambda u: [(u, 1)], "url string, n long", combiner=add)
    assert small.count() == 100  # too few to combine


def test_reduce_streams_values_skips_and_orders(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), ("c", 9)], "k string, v int")
    first = lambda k, values: [(k, [v for v in values])]
    got = {r["k"]: r["vs"] for r in mapreduce.reduce_phase(df, first, "k string, vs array<int>", skip=lambda k, v: v == 9, order=["v"]).collect()}
    assert got == {"a": [1, 3], "b": [2], None: [5]}
    assert mapreduce.reduce_phase(df.where("false"), first, "k string, vs array<int>").count() == 0
    grouped = mapreduce.reduced_map(df, lambda k, values: [(k, sum(values))], "k string, s int")
    assert {r["k"]: r["s"] for r in grouped.collect()}["a"] == 4


def test_large_numbers_nulls_and_nan_stay_as_they_are(spark):
    big, nan = 2**60 + 1, float("nan")
    df = spark.createDataFrame([(big, 1.5, "a"), (None, nan, None), (big, None, "a")], "k long, x double, s string").coalesce(1)
    rows = mapreduce.map_phase(df, lambda k, x, s: [(k, x)], "k long, x double").collect()
    assert [r["k"] for r in rows] == [big, None, big] and rows[2]["x"] is None and math.isnan(rows[1]["x"])
    sums = mapreduce.reduce_phase(df.select("k", "x"), lambda k, xs: [(k, sum(x is not None for x in xs))], "k long, n long")
    assert sorted(map(tuple, sums.collect()), key=str) == [(big, 1), (None, 1)]
    floats = spark.createDataFrame([(nan, 1), (nan, 2), (None, 3), (0.5, 4)] * 300, "k double, v long")
    add = lambda k, vs: [(k, sum(vs))]
    got = mapreduce.map_reduce(floats, lambda k, v: [(k, v)], "k double, v long", add, "k double, v long", combiner=add).collect()
    assert sorted((str(r["k"]), r["v"]) for r in got) == [("0.5", 1200), ("None", 900), ("nan", 900)]
    lists = spark.createDataFrame([([1, None], 1), ([1, None], 2), ([], 3)] * 300, "k array<long>, v long")
    got = mapreduce.map_reduce(lists, lambda k, v: [(k, v)], "k array<bigint>, v long", add, "k array<bigint>, v long", combiner=add).collect()
    assert sorted((str(r["k"]), r["v"]) for r in got) == [("[1, None]", 900), ("[]", 900)]


def test_errors_fail_and_bad_records_become_null(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(Exception, match="invalid literal"):
        mapreduce.map_phase(df, lambda v: [(v, int(v))], "k string, n long").collect()
    safe = mapreduce.parse_or_null(int)
    assert {tuple(r) for r in mapreduce.map_phase(df, lambda v: [(v, safe(v))], "k string, n long").collect()} == {("1", 1), ("x", None)}


def test_jobs_and_sinks(spark, tmp_path):
    out = mapreduce.split_job(spark, ["to", "be", "or", "not"], len, T.StringType(), T.LongType())
    assert mapreduce.aggregate_results(out, sum) == 9
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    mapreduce.scatter(df, "k", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    mapreduce.gather(df, "gathered")
    assert spark.table("gathered").count() == 3
    assert csvio.append_checked(df, "gathered", 3) == 3
    with pytest.raises(ValueError):
        csvio.append_checked(df, "gathered", 4)
    spark.sql("drop table gathered")
    mapreduce.gather_views([df, df.select("v", "k")], "all_parts")
    assert spark.table("all_parts").count() == 6
    ring = Ring(["n1", "n2"])
    assert sorted(map(tuple, mapreduce.output_keys(df, ring).collect())) == sorted((k, ring.node(str(k)), n) for k, n in Counter(r[0] for r in df.collect()).items())


# -- k-means ----------------------------------------------------------------------------------------------------------


def test_kmeans(spark):
    points = generators.gaussian(spark, 300, [[0.0, 0.0], [10.0, 10.0], [-10.0, 5.0]], 0.5, seed=3)
    centroids, labelled, turns = kmeans.fit(points, "features", 3, start=[[1, 1], [9, 9], [-9, 4]])
    assert turns < 5 and [round(c[0]) for c in centroids] == [0, 10, -10]
    assert labelled.where("label <> centre").count() == 0
    assert {r["n"] for r in kmeans.group_sizes(labelled).collect()} == {100}
    tie = spark.createDataFrame([([0.0],), (None,)], "f array<double>")
    assert [r["label"] for r in kmeans.assign(tie, "f", [[1.0], [-1.0]]).collect()] == [0, None]
    far, _, _ = kmeans.fit(points, "features", 2, start=[[0, 0], [9999, 9999]])
    assert far[1] == [9999.0, 9999.0]
    assert kmeans.fit(points.where("false"), "features", 2)[0] == []
    random_start, _, _ = kmeans.fit(points, "features", 3, seed=1)
    assert len(random_start) == 3
    m = {r["label"]: (r["n"], r["mean"]) for r in kmeans.means(spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (None, [9.0, 9.0])], "label int, f array<double>"), "f", "label").collect()}
    assert m == {0: (2, [2.0, 3.0])}
    assert 20 < kmeans.sample(points, 100, 300, 1).count() < 180 and kmeans.sample(points, 9, 0).count() == 0


def test_generators(spark):
    z = generators.zipf(spark, 5000, 1.2, 50, 2).select(F.explode("features").alias("x"))
    assert z.agg(F.min("x"), F.max("x")).first() == (1.0, 50.0)
    assert z.where("x = 1").count() > z.where("x = 2").count() > z.where("x = 9").count()
    u = generators.uniform(spark, 100, 3).select(F.explode("features").alias("x"))
    assert u.count() == 300 and u.where("x < 0 or x >= 1").count() == 0


# -- text in and out --------------------------------------------------------------------------------------------------


def test_csv(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('1\t"two\nlines"\t"say ""x"""\n2\t\t""\n')
    got = [tuple(r) for r in csvio.read_csv(spark, str(p), "a int, b string, c string").collect()]
    assert got == [(1, "two\nlines", 'say "x"'), (2, None, "")]
    h = tmp_path / "h.csv"
    h.write_text("id,Name\n1,x\n")
    assert csvio.read_csv(spark, str(h), sep=",", header=True).columns == ["ID", "NAME"]
    lines = spark.createDataFrame([('1|"a|b"|c',), ("2|open",)], "line string")
    assert [r["fields"] for r in csvio.pick_fields(lines, "line", [2, 3], sep="|").collect()] == [["a|b", "c"], ["open", None]]
    with pytest.raises(ValueError):
        csvio.pick_fields(lines, "line", [2, 1])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a,b")], "i int, s string")
    assert [r["value"] for r in csvio.csv_lines(df).collect()] == ["1,", '2,""', '3,"a,b"']
    assert [r["value"] for r in csvio.csv_lines(df, quote_all=False).collect()] == ["1,", "2,", '3,"a,b"']
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "x.dat").write_text("1 2.5\n\n -3  4e1\n")
    assert [r["features"] for r in csvio.read_points(spark, str(tmp_path / "points"), ".dat").collect()] == [[1.0, 2.5], [-3.0, 40.0]]
    assert sum(len(f) for f in csvio.query_rows(spark, "select id from range(25)", 10)) == 25


def test_jdbc(spark):
    url, driver = f"jdbc:derby:memory:t{random.randrange(10**9)};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"n{i}") for i in range(30)], "ID int, NAME string")
    csvio.write_jdbc(df, url, "T", replace=False, driver=driver)
    csvio.write_jdbc(df.where("ID < 20"), url, "T", driver=driver)
    csvio.write_jdbc(df.where("ID = 25"), url, "T", replace=False, driver=driver)
    got = csvio.read_jdbc(spark, url, "select ID, NAME from T where ID > 9", driver=driver)
    assert sorted(r["ID"] for r in got.collect()) == [*range(10, 20), 25]
    side = csvio.read_jdbc(spark, url, "select * from T", driver=driver, partitionColumn="ID", lowerBound="0", upperBound="30", numPartitions="3")
    assert side.count() == 21 and side.where("NAME is null").count() == 7 and side.rdd.getNumPartitions() == 3
    pairs = mapreduce.map_phase(got, lambda i, n: [(n, i)], "k string, v long", skip=lambda i, n: n is None)
    assert pairs.count() == 8


ON_CLUSTER = """
import sys
import __spark_entry__
from pyspark.sql import SparkSession
from fragsql.sources import csvio, embedded
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.checkpoint.dir": "file://" + sys.argv[1] + "/shared", "spark.sql.warehouse.dir": sys.argv[1] + "/warehouse"}
conf |= {"spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
ops, data = __spark_entry__.queries(), sys.argv[2]
"""


def on_cluster(code, tmp_path, data):
    """What code prints last in a session whose executors are processes of their own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", ON_CLUSTER + code + "spark.stop()", str(tmp_path), data], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return ast.literal_eval(done.stdout.splitlines()[-1])


def test_database_job_beside_executors(data, duck, tmp_path):
    code = """
embedded.ROWS = 1000
jobs = sorted(map(tuple, ops["op_database_job"](spark, data).collect()))
url, driver = "jdbc:derby:memory:t;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
df = spark.range(2500).selectExpr("id as ID", "if(id % 3 = 0, null, 'n' || id) as NAME", "timestamp_seconds(id) as AT", "cast(id as decimal(9, 2)) as D")
csvio.write_jdbc(df, url, "T", replace=False, driver=driver)
spark.conf.set("spark.sql.datetime.java8API.enabled", "true")
csvio.write_jdbc(df.where("ID < 2000"), url, "T", driver=driver)
spark.conf.set("spark.sql.datetime.java8API.enabled", "false")
csvio.write_jdbc(df.where("ID >= 2400"), url, "T", replace=False, driver=driver)
some = csvio.read_jdbc(spark, url, "select * from T", driver=driver, partitionColumn="ID", lowerBound="0", upperBound="30", numPartitions="3")
none = csvio.read_jdbc(spark, url, "select ID from T where ID < 0", driver=driver)
want = df.where("ID < 2000 or ID >= 2400")
print((jobs, some.count(), some.exceptAll(want).count(), want.exceptAll(some).count(), none.count(), none.columns))
"""
    jobs, n, more, fewer, none, columns = on_cluster(code, tmp_path, data)
    assert jobs == sorted(duck.execute("select o_orderpriority, count(*) from orders group by 1").fetchall())
    assert (n, more, fewer, none, columns) == (2100, 0, 0, 0, ["ID"])


def test_execute_update_beside_executors(data, tmp_path):
    code = """
print([tuple(r) for r in ops["op_execute_update"](spark, data).collect()])
"""
    assert on_cluster(code, tmp_path, data) == [("create", 0), ("insert", 5), ("delete", 3)]


# -- functions --------------------------------------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    numbers = {"1": True, "-1.5e-3": True, "0x1F": True, "-0xff": True, "0x": False, "1.": False, ".5": True, "1e": False, "1e+": False, "1L": True, "1.5f": True, "1e5L": False, "1e5d": True, "+1": False, "": False, "a": False, "1..2": False}
    df = spark.createDataFrame([(k,) for k in numbers], "s string")
    assert {r["s"]: r["x"] for r in df.select("s", text.is_number("s").alias("x")).collect()} == numbers
    assert one(spark, text.is_number(F.lit(None).cast("string"))) is False
    assert one(spark, text.count_matches(F.lit("aaaa"), "aa")) == 2 and one(spark, text.count_matches(F.lit(None).cast("string"), "a")) == 0 and one(spark, text.count_matches(F.lit("a"), "")) == 0
    assert [one(spark, text.nth_index(F.lit("a/b/c"), "/", i)) for i in (1, 2, 3)] == [1, 3, -1]
    with pytest.raises(ValueError):
        text.nth_index("s", "/", 0)
    assert one(spark, text.strip(F.lit(" \tx y\n"))) == "x y" and one(spark, text.strip_start(F.lit("xxa"), "x")) == "a" and one(spark, text.strip_end(F.lit("a  "))) == "a"
    assert one(spark, text.encode_hex(F.lit("aé"))) == "61C3A9" and one(spark, text.decode_hex(F.lit("zz"))) is None
    assert one(spark, text.escape(F.lit("a'\"\\\n\x01é€"))) == "a\\'\\\"\\\\\\n\\u0001\\u00e9\\u20ac" and one(spark, text.escape(F.lit(""))) == ""
    sizes = {0: "0 bytes", 1023: "1023 bytes", 1536: "1.50 kB", 5 << 20: "5.00 MB", 3 << 30: "3.00 GB", -2048: "-2.00 kB"}
    assert {k: one(spark, text.display_bytes(F.lit(k).cast("long"))) for k in sizes} == sizes
    spans = {0: "0ms", 5: "5ms", 61_001: "1m 1s 1ms", 3_600_000: "1h "}
    assert {k: one(spark, text.format_millis(F.lit(k))) for k in spans} == spans
    assert one(spark, text.to_bits(F.lit(5), 8)) == "00000101" and one(spark, text.to_bits(F.lit(-1), 8)) == "1" * 8


def test_arrays(spark):
    f = lambda g, *x: one(spark, g(F.array(*[F.lit(v) for v in x]).cast("array<int>")))
    assert f(arrays.array_sum, 1, None, 4) == 5 and f(arrays.array_mean, 1, None, 4) == 2.5 and f(arrays.array_variance, 1, 2, 3, 4) == pytest.approx(5 / 3)
    assert f(arrays.array_stddev, 2, 4) == pytest.approx(2**0.5) and f(arrays.array_least, -1, -5) == -5 and f(arrays.array_most, -1, -5) == -1
    assert f(arrays.array_sum) == 0 and f(arrays.array_mean) is None and f(arrays.array_variance, 1) is None
    assert one(spark, arrays.array_mean(F.lit(None).cast("array<int>"))) is None


def test_hashes(spark):
    assert one(spark, hashes.hash_column("fnv1a_32", F.lit("a"))) == 0xE40C292C - (1 << 32)
    assert one(spark, hashes.hash_column("FNV1A_64", F.lit("a"))) == 0xAF63DC4C8601EC8C - (1 << 64)
    assert one(spark, hashes.hash_column("fnv1_32", F.lit("a"))) == 0x050C5D7E
    assert one(spark, hashes.hash_column("crc32", F.lit("a"))) == 0xE8B7BE43
    assert one(spark, hashes.hash_column("fnv1a_32", F.lit(None).cast("string"))) is None
    with pytest.raises(ValueError):
        hashes.hash_column("md4", "x")
    assert [hashes.next_power_of_two(n) for n in (0, 1, 3, 128, 129)] == [1, 1, 4, 128, 256]
    assert hashes.is_power_of_two(64) and not hashes.is_power_of_two(0) and hashes.shift_of(128) == 7
    with pytest.raises(ValueError):
        hashes.shift_of(100)
    buckets = [r[0] for r in spark.range(1000).select(hashes.fold_bucket(F.hash("id"), 16)).collect()]
    assert set(buckets) == set(range(16)) and hashes.load_balance([3, 3, 3]) == 0


# -- flow language ----------------------------------------------------------------------------------------------------


def write_configs(folder):
    (folder / "p.csv").write_text("node,master,dbUrl,user,password,mapOutput\nn1,,u1,a,b,out\ns1,n1,u2,,,\nn2,,u3,,,\nn3,,u4,,,\n")
    (folder / "r.csv").write_text('ID,NODE,DBURL,USER,PASSWORD,XFER_PORT,SHUFFLE_DATASINK\nr1,n1,u,,,5000,"a, b"\nr2,n2,u,,,,\n')
    (folder / "e.csv").write_text("ID,node,master,dbUrl,user,password,mapOutput,XFER_PORT,SHUFFLE_DATASINK\ne1,n1,,u1,,,,1,x\n")


def test_configs(spark, tmp_path):
    write_configs(tmp_path)
    parts = configs.load_partitions(spark, str(tmp_path / "p.csv"))
    assert [p.node for p in parts] == ["n1", "n2", "n3"] and [s.node for s in parts[0].slaves] == ["s1"] and parts[0].map_output == "out"
    reducers = configs.load_reducers(spark, str(tmp_path / "r.csv"))
    assert reducers[0].port == 5000 and [reducers[0].sink() for _ in range(3)] == ["a", "b", "a"] and reducers[1].sink() is None
    assert configs.load_elements(spark, str(tmp_path / "e.csv"))[1][0].id == "e1"
    (tmp_path / "bad.csv").write_text("NODE\nx\n")
    for bad in ("bad.csv", "p.txt"):
        with pytest.raises(ValueError):
            configs.load_partitions(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        configs.partitions([{"NODE": "s", "MASTER": "gone", "DBURL": "u", "USER": None, "PASSWORD": None, "MAPOUTPUT": None}])


def test_parse():
    got = flow.parse("""
      -- a comment; with a semicolon
      LOAD PARTITIONS INTO CATALOG "c1" FROM FILE "p.csv";
      load reducers from file 'r.csv';   /* another { */
      map-and-shuffle { SELECT a, '}'' ' -- no brace here
        from t; } Catalog_Name = "c1" num_reducers = 4 distributed by hash(a, "b c");
      map { create view v as select 1 \\} ; select * from v; };
      reduce at pe1 { select * from <src>; };
      let $x := spawn { map { select 1 }; }; sync $x, $y; SYNC ALL;
    """.replace("'}'' '", "'x'").replace("no brace here", "no comment end"))
    kinds = [c.kind for c in got]
    assert kinds == ["load partitions", "load reducers", "map-and-shuffle", "map", "reduce", "spawn", "sync", "sync"]
    assert got[0].catalog == "c1" and got[2].properties == {"num_reducers": 4, "keys": ["a", "b c"]} and "}" in got[3].body
    assert got[4].properties["element"] == "pe1" and got[6].properties["variables"] == ["x", "y"]
    for bad in ("load partitions from table t;", "map { select 1 }", "map-and-shuffle { select 1; select 2; };", "map-and-shuffle { drop view v };", "reduce { select 1 };", "jump;", "map { open"):
        with pytest.raises(flow.FlowError):
            flow.parse(bad)


def test_flow_runs(spark, data, tmp_path):
    from fragsql.queries import tpch

    write_configs(tmp_path)
    p = flow.Processor(spark, tpch.fragments(spark, data), tpch.catalog())
    out = p.run(f"""
      load partitions from file "{tmp_path}/p.csv"; load reducers from file "{tmp_path}/r.csv";
      let $v := spawn {{ map {{ select count(*) as n from nation }}; }}; sync $v;
      map-and-shuffle {{ select o_orderstatus, count(*) as n from orders where orders partitioned by (o_orderkey) group by o_orderstatus; }} distributed by hash(o_orderstatus);
      reduce at r1 {{ select o_orderstatus, sum(n) as n from <src> group by o_orderstatus; }};
      map {{ create view big as select * from orders where o_totalprice > 100000; select count(*) as n from big; }};
    """)
    by_kind = {c.kind: df for c, df in out}
    want = {r[0]: r[1] for r in spark.read.parquet(f"{data}/orders.parquet").groupBy("o_orderstatus").count().collect()}
    assert {r[0]: r[1] for r in by_kind["reduce"].collect()} == want
    assert by_kind["map-and-shuffle"].rdd.getNumPartitions() == 2 and by_kind["map"].count() == 1
    assert p.variables["v"].result()[0].first()["n"] > 0
    assert len(p.partitions()) == 3 and p.execute_query("select 1 as x").first()["x"] == 1
    assert p.execute_command(flow.Command("map", "select 2 as x")).first()["x"] == 2
    for bad in ("reduce at nobody { select 1 };", "sync $none;"):
        with pytest.raises(flow.FlowError):
            p.run(bad)
    assert p.delete_catalog("default") and not p.delete_catalog("none")


def test_map_phase_without_shards(spark):
    assert map_phase(spark, "select * from t", {"t": spark.range(3)}).count() == 3


# -- command line, streams, entry -------------------------------------------------------------------------------------


def test_command_line(spark, data, tmp_path, capsys):
    (tmp_path / "m.sql").write_text("select r_regionkey as k from region;")
    (tmp_path / "r.sql").write_text("select max(k) from <src>")
    (tmp_path / "f.flow").write_text("map { select count(*) from region };")
    assert cli.main(["--data", data, "execute", "--map-query", f"{tmp_path}/m.sql", "--reduce-query", f"{tmp_path}/r.sql", "--output-method", "scalarString"], spark) == 0
    assert capsys.readouterr().out.strip() == "4"
    cli.main(["--data", data, "register", "a:x:y=b", "b:y"], spark)
    assert capsys.readouterr().out == "a\t1\t1\nb\t2\t2\n"
    cli.main(["--data", data, "flow", f"{tmp_path}/f.flow"], spark)
    assert "map" in capsys.readouterr().out


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("url"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    rows.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    partial_counts(stream, ["url"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["url"]: r["n"] for r in total_counts(spark.read.parquet(str(tmp_path / "out")), ["url"]).collect()}
    assert got == {r["url"]: r["count"] for r in rows.groupBy("url").count().collect()}
    q = windowed_counts(stream, "url", "ts").writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    days = spark.table("windows").groupBy("start").agg(F.sum("n").alias("n")).collect()
    assert all(r["n"] <= 144 for r in days)


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    names = list(e.queries())
    assert names.index("p5_method") < names.index("p5_found")


def test_k_means_goes_on_until_centroids_rest(spark):
    points = spark.range(60).select(F.array(F.col("id").cast("double")).alias("features")).coalesce(1)
    start = [[float(i)] for i in range(5)]
    fitted = kmeans.fit(points, "features", 5, start=start)
    centroids, _, turns = fitted
    assert fitted.converged and turns > 20
    again = kmeans.fit(points, "features", 5, 1, start=centroids)
    assert again.converged and again[0] == centroids
    assert not kmeans.fit(points, "features", 5, 2, start=start).converged


def test_kmeans_of_gaps_and_lengths(spark):
    rows = [(1, "a", [1.0, 2.0]), (2, "a", [3.0, None]), (3, "b", [5.0]), (4, None, [9.0, 9.0]), (5, "b", None), (6, "a", [1.0, 2.0, 7.0])]
    df = spark.createDataFrame(rows, "i int, l string, f array<double>").repartition(3)
    got = {r["l"]: (r["n"], r["mean"]) for r in kmeans.means(df, "f", "l").collect()}
    assert got == {"a": (3, [5 / 3, 2.0, 7.0]), "b": (1, [5.0])}
    near = {r["i"]: r["label"] for r in kmeans.assign(df, "f", [[1.0, 2.0], [9.0, 9.0], [9.0, 9.0]]).collect()}
    assert near == {1: 0, 2: None, 3: None, 4: 1, 5: None, 6: None}
    assert kmeans.means(df.where("false"), "f", "l").count() == 0 and kmeans.assign(df.where("false"), "f", [[1.0]]).count() == 0


# -- hash families, codecs, stores at nodes, jobs ---------------------------------------------------------------------------


def scalar(f, data):
    return hashes._in_batches([data], f)[0]


def murmur2(data, bits):
    width, m, r = (4, hashes.MURMUR32, 24) if bits == 32 else (8, hashes.MURMUR64, 47)
    mask, i = (1 << bits) - 1, 0
    h = hashes.SEED ^ (len(data) if bits == 32 else len(data) * m & mask)
    while len(data) - i >= width:
        k = int.from_bytes(data[i : i + width], "little") * m & mask
        k = (k ^ k >> r) * m & mask
        h = (h * m ^ k) & mask if bits == 32 else (h ^ k) * m & mask
        i += width
    if i < len(data):
        h = (h ^ int.from_bytes(data[i:], "little")) * m & mask
    a, b = (13, 15) if bits == 32 else (47, 47)
    h = (h ^ h >> a) * m & mask
    return h ^ h >> b


def lookup8(data):
    mask, s = (1 << 64) - 1, [hashes.SEED, hashes.SEED, hashes.GOLDEN64]

    def mix():
        for i, k in enumerate(hashes.LOOKUP8_MIX):
            x, y, z = i % 3, (i + 1) % 3, (i + 2) % 3
            s[x] = (s[x] - s[y] - s[z]) & mask
            s[x] ^= s[z] >> k if k > 0 else s[z] << -k & mask

    word = lambda b: int.from_bytes(b, "little")
    at = 0
    while len(data) - at >= 24:
        for i in range(3):
            s[i] = s[i] + word(data[at + 8 * i : at + 8 * i + 8]) & mask
        mix()
        at += 24
    rest = data[at:]
    s[0], s[1] = s[0] + word(rest[:8]) & mask, s[1] + word(rest[8:16]) & mask
    s[2] = s[2] + len(data) + (word(rest[16:]) << 8) & mask
    mix()
    return s[2]


@given(st.binary(max_size=80))
def test_hash_families(data):
    assert scalar(hashes.murmur_32, data) & 0xFFFFFFFF == murmur2(data, 32)
    assert scalar(hashes.murmur_64, data) & (1 << 64) - 1 == murmur2(data, 64)
    assert scalar(hashes.jenkins_64, data) & (1 << 64) - 1 == lookup8(data)


def test_published_values_of_hashes(spark):
    # fixed values: published with the function
    assert scalar(lambda r, n: hashes.jenkins_32(r, n, 0), b"Four score and seven years ago") == 0x17770551
    assert scalar(lambda r, n: hashes.jenkins_32(r, n, 0), b"") & 0xFFFFFFFF == 0xDEADBEEF
    assert one(spark, hashes.hash_column("native", F.lit("hello"))) == 99162322
    assert one(spark, hashes.hash_column("PURE_SHA1", F.lit("abc"))) == 0xA9993E36
    mixed = [b"", None, b"a" * 1000, b"ab", b"abc" * 20]
    assert hashes._in_batches(mixed, hashes.murmur_64) == [None if b is None else scalar(hashes.murmur_64, b) for b in mixed]


@given(st.one_of(st.binary(max_size=3000), st.text("ab", max_size=3000).map(str.encode), st.integers(0, 5000).map(lambda n: b"x" * n)))
def test_codecs_round_trip(data):
    packed = codecs.lzf_compress(data)
    assert codecs.lzf_decompress(packed) == data
    assert len(packed) <= len(data) + -(-len(data) // 32) + 3


def test_codec_columns_and_errors(spark):
    df = spark.createDataFrame([("hello " * 500,), ("",), (None,)], "t string")
    for codec in ("LZF", "deflate"):
        packed = df.select("t", codecs.compress("t", codec).alias("p"))
        assert packed.where(~codecs.decompress("p", codec).cast("string").eqNullSafe(F.col("t"))).count() == 0
        assert packed.agg(F.max(F.octet_length("p"))).first()[0] < 200
    with pytest.raises(ValueError):
        codecs.lzf_decompress(b"\x05\x00\x00\x00a")
    with pytest.raises(ValueError):
        codecs.lzf_decompress(b"\x05\x00\x00\x20\x00")


def test_copies_at_nodes(spark, tmp_path):
    ring = Ring(["n1", "n2", "n3"])
    kv = KVStore(spark, str(tmp_path), ring=ring)
    kv.add("i", {f"k{i}": f"v{i}" for i in range(30)}, replicas=1)
    kv.add("i", {"k0": "w"})
    kv.put("i", {"k1": "new"}, replicas=2)
    assert kv.get("i", "k0") == [b"v0", b"w"] and kv.get("i", "k1") == [b"new"] and kv.table("i").count() == 31
    for node in ring.nodes:
        lost = {("k0", b"w")} if ring.node("k0") == node else set()
        rest = {(bytes(r["key"]).decode(), bytes(r["value"])) for r in kv.table("i", [node]).collect()}
        assert rest == {(f"k{i}", f"v{i}".encode()) for i in range(30) if i != 1} | {("k1", b"new"), ("k0", b"w")} - lost
    for node in ring.nodes:
        owned = {bytes(r["key"]).decode() for r in kv._copies("i").where((F.col("node") == node) & (F.col("replica") == 0)).collect()}
        assert all(ring.node(k) == node for k in owned)
    assert kv.remove("i", "k1") and kv._copies("i").where("cast(key as string) = 'k1'").count() == 0
    with pytest.raises(ValueError):
        KVStore(spark, str(tmp_path / "none")).add("i", {"a": "b"}, replicas=1)


def test_layouts(spark, tmp_path):
    for layout in ("plain", "hashed"):
        kv = KVStore(spark, str(tmp_path / layout), layout)
        kv.add("i", [("a", "1"), ("b", "2"), ("a", "3")])
        assert sorted(kv.get("i", "a")) == [b"1", b"3"] and kv.scan("i").count() == 3 and kv.multi_get("i", ["a", "b", "c"]).count() == 2
    with pytest.raises(NotImplementedError):
        kv.prefix_search("i", "a")
    with pytest.raises(ValueError):
        KVStore(spark, str(tmp_path), "none")


def test_tasks_are_tried_again(spark, tmp_path):
    def flaky(k):
        mark = tmp_path / f"done{k}"
        if not mark.exists():
            mark.write_text("")
            raise OSError("once")
        return k + 1

    assert jobs.run_tasks(spark, [3, 1, 2], flaky, T.LongType(), T.LongType()) == [(3, 4), (1, 2), (2, 3)]
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        jobs.run_tasks(spark, [0], lambda k: 1 // k, T.LongType(), T.LongType(), retries=1)
    assert jobs.run_tasks(spark, [], flaky, T.LongType(), T.LongType()) == []


def test_options_of_execute():
    args = cli.parser().parse_args(["--data", "d", "execute", "--map-query", "m", "--reduce-query", "r", "--wait-spe", "--delegate", "spark://h:7077"])
    assert cli.settings(args) == {"spark.master": "spark://h:7077", "spark.speculation": "false", "spark.task.maxFailures": "1"}
    args = cli.parser().parse_args(["--data", "d", "execute", "--map-query", "m", "--reduce-query", "r", "--failover"])
    assert cli.settings(args) == {"spark.speculation": "true", "spark.task.maxFailures": "4"}
