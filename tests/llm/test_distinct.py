"""Sketches: accuracy within the known error, merging, and edge cases."""

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from fragsql.llm import distinct, queries


@pytest.mark.parametrize("n", [0, 1, 10, 1000, 50_000, 400_000])
def test_accuracy(spark, n):
    df = spark.range(n * 2).select(F.lit("g").alias("g"), (F.col("id") % max(n, 1)).cast("string").alias("v"))
    got = distinct.estimate(distinct.build(df, ["g"], "v"), ["g"], sigmas=4).collect()
    if not n:
        assert got == []
        return
    (r,) = got
    assert r["records"] == 2 * n and r["low"] <= n <= r["high"]
    assert r["error"] <= 0.0075 * n + 1 if n < 4096 else r["error"] < 0.0105 * n


def test_known_error_holds_over_many_sketches():
    rng = np.random.default_rng(3)
    for n, rows in ((300, 256), (20_000, 256), (3_000_000, 64)):
        off = []
        for _ in range(60):
            ranks = np.minimum(rng.geometric(0.5, n) - 1, distinct.RANKS - 1)
            cells = rng.integers(0, rows, n)
            bits = np.zeros((rows, distinct.RANKS), bool)
            bits[cells, ranks] = True
            e, s = distinct.likelihood(bits.sum(0)[None, :], rows)
            off.append((e[0] - n) / s[0])
        assert abs(np.mean(off)) < 0.6 and 0.7 < np.std(off) < 1.35
        assert s[0] / n <= 0.65 / np.sqrt(rows) * 1.1


def test_parts_merge_to_the_whole(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("p"), (F.col("id") % 7000).cast("string").alias("v"))
    whole = distinct.estimate(distinct.build(df.select("v", F.lit(1).alias("g")), ["g"], "v"), ["g"]).first()
    merged = distinct.merge(distinct.build(df, ["p"], "v").withColumn("g", F.lit(1)), ["g"])
    again = distinct.estimate(merged, ["g"]).first()
    assert whole == again


def test_empty_groups_nulls_and_many_groups(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), (None, "z"), ("b", None), ("c", "")], "g string, v string")
    got = {r["g"]: (r["records"], round(r["estimate"])) for r in distinct.estimate(distinct.build(df, ["g"], "v"), ["g"]).collect()}
    assert got == {"a": (1, 1), None: (2, 2), "c": (1, 1)}
    many = spark.range(6000).select((F.col("id") % 700).alias("g"), F.col("id").alias("v"))
    rows = distinct.estimate(distinct.build(many, ["g"], "v"), ["g"]).collect()
    assert len(rows) == 700 and all(abs(r["estimate"] - r["records"]) <= 1 for r in rows)
    with pytest.raises(ValueError):
        distinct.build(df, ["g"], "v", rows=100)


def test_found_and_levels(spark, data, duck):
    same(queries.p4_found(spark, data), duck, queries.SQL["p4_found"])
    got = {(r["level"], r["day"], r["node"], r["field"]): r for r in queries.p4_distinct(spark, data).collect()}
    want = duck.execute("""select cast(date '1970-01-01' + cast(floor(time / 86400000.0) as integer) as varchar), count(distinct url), count(*)
      from access_log where url <> '' group by 1""").fetchall()
    for day, n, rows in want:
        r = got["day", day, None, "url"]
        assert r["records"] == rows and r["low"] - 1 <= n <= r["high"] + 1
