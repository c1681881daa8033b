"""Frequent items and top n per group against brute force, and their edge cases."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fragsql.llm.frequent import frequent_items
from fragsql.llm.topn import score_bucket, top_n_per_group


def skewed(seed, rows=4000):
    rnd = random.Random(seed)
    return [rnd.choice(["hot"] * 5 + ["warm"] * 2 + [None]) if rnd.random() < 0.4 else f"v{int(rnd.paretovariate(0.6)) % 900:03d}" for _ in range(rows)]


def brute_top(values, k):
    order = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))
    return [(v, n, i + 1) for i, (v, n) in enumerate(order[:k])]


@pytest.mark.parametrize(("seed", "k", "chunk"), [(1, 10, 200), (2, 25, 64), (3, 1, 1000), (4, 5000, 128)])
def test_frequent_against_brute_force(spark, seed, k, chunk):
    values = skewed(seed)
    df = spark.createDataFrame([(v, 1) for v in values], "v string, n int").repartition(7)
    got = [(r["v"], r["n"], r["rank"]) for r in frequent_items(df, "v", k, chunk_rows=chunk).orderBy("rank").collect()]
    assert got == brute_top(values, k)


def test_frequent_ties_at_the_last_place(spark):
    values = [f"t{i:02d}" for i in range(40) for _ in range(3)] + ["top"] * 9
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = [(r["v"], r["n"]) for r in frequent_items(df, "v", 4, chunk_rows=16).orderBy("rank").collect()]
    assert got == [("top", 9), ("t00", 3), ("t01", 3), ("t02", 3)]


def test_frequent_with_a_share(spark):
    values = ["a"] * 50 + ["b"] * 25 + ["c"] * 24 + ["d"]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    got = {r["v"] for r in frequent_items(df, "v", 4, Fraction(1, 4), chunk_rows=9).collect()}
    assert got == {"a", "b"}


def test_frequent_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("",), ("x" * 100_000,)], "v string")
    got = [(r["v"], r["n"]) for r in frequent_items(df, "v", 9).orderBy("rank").collect()]
    assert got == [("", 2), ("x" * 100_000, 1), (None, 1)]
    assert frequent_items(df.where("false"), "v", 3).count() == 0
    numbers = spark.range(100).select((F.col("id") % 3).alias("rank"), F.lit(1).alias("n"))
    got = frequent_items(numbers, "rank", 1)
    assert got.columns == ["value", "n", "rank"] and [tuple(r) for r in got.collect()] == [(0, 34, 1)]
    with pytest.raises(ValueError):
        frequent_items(df, "v", 0)


def test_rare_values_stay_where_they_are(spark):
    values = ["hot"] * 3000 + [f"r{i}" for i in range(3000)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    frequent_items(df, "v", 1, chunk_rows=1000).collect()
    from fragsql import runtime

    above = [p for _, p in runtime._staged if "fragsql-above" in p][-1]
    assert spark.read.parquet(above).count() < 50


def brute_groups(rows, n, min_items=1):
    groups = {}
    for g, i, s in rows:
        groups.setdefault(g, []).append((i, s))
    rank = lambda x: (x[1] is None, 0 if x[1] is None else (-float("inf") if x[1] != x[1] else -x[1]), x[0])
    return {(g, i, k + 1) for g, items in groups.items() if len(items) >= min_items for k, (i, s) in enumerate(sorted(items, key=rank)[:n])}


@pytest.mark.parametrize(("seed", "n", "min_items", "bound"), [(1, 3, 4, 1000), (2, 1, 1, 2), (3, 20, 1, 1000), (4, 1200, 1, 0)])
def test_top_n_against_brute_force(spark, seed, n, min_items, bound):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None, f"g{rnd.randrange(200)}"]), i, rnd.choice([None, float("nan"), -5.0, 0.0, 1.0, 2.0, rnd.expovariate(0.01)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, s double").repartition(6)
    got = {(r["g"], r["i"], r["rank"]) for r in top_n_per_group(df, ["g"], "s", ["i"], n, min_items, bound=bound).collect()}
    assert got == brute_groups(rows, n, min_items)


def test_thresholds_drop_rows_of_large_groups_early(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 1000).alias("s"))
    out = top_n_per_group(df, ["g"], "s", ["id"], 2)
    assert sorted((r["g"], r["rank"], r["id"]) for r in out.collect()) == [(0, 1, 998), (0, 2, 1998), (1, 1, 999), (1, 2, 1999)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_a_group_of_equal_scores_is_ranked_in_parts(spark):
    df = spark.range(30_000).select(F.lit(1).alias("g"), "id", F.lit(5).alias("s"))
    out = top_n_per_group(df, ["g"], "s", ["id"], 2000)
    assert sorted((r["rank"], r["id"]) for r in out.collect()) == [(i + 1, i) for i in range(2000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2 and "salt" in plan
    repeated = spark.range(5000).select(F.lit(1).alias("g"), F.lit(7).alias("id"), F.lit(5).alias("s"))
    assert top_n_per_group(repeated, ["g"], "s", ["id"], 2000).count() == 2000


def test_every_group_gets_its_threshold(spark):
    df = spark.range(20_000).select((F.col("id") % 400).alias("g"), "id", (F.col("id") % 977).alias("s"))
    for bound in (1000, 0):
        out = top_n_per_group(df, ["g"], "s", ["id"], 2, bound=bound)
        assert out.count() == 800
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=shuffle_hash" in plan) == (bound == 0) and "strategy=broadcast" in plan


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 5, "y"), ("b", 2, None, "z")], "g string, i int, s int, extra string")
    got = sorted((r["g"], r["rank"], r["extra"]) for r in top_n_per_group(df, ["g"], "s", ["i", "extra"], 5).collect())
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    assert top_n_per_group(df.where("false"), ["g"], "s", ["i"], 3).count() == 0
    odd = df.withColumnsRenamed({"extra": "rank", "i": "bucket"}).withColumn("c0", F.lit(7))
    assert top_n_per_group(odd, ["g"], "s", ["rank"], 1).columns == ["g", "bucket", "s", "rank", "c0", "rank_"]
    one = top_n_per_group(df, [], "s", ["i"], 1).collect()
    assert len(one) == 1 and one[0]["s"] == 5


def test_buckets_follow_the_order(spark):
    values = [None, float("-inf"), -1e308, -7.5, -0.1, 0.0, 1e-9, 0.5, 1.0, 3.0, 1e18, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, s double")
    got = [r[0] for r in df.orderBy("i").select(score_bucket(F.col("s"))).collect()]
    assert got == sorted(got)
