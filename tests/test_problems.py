"""Eager joins, rolling totals, positions and measurement faults on small fixtures, edge cases included."""

import math
import random
from statistics import median

import numpy as np
import pytest
from conftest import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragsql.operators.eager_join import eager_join_aggregate
from fragsql.operators.positions import exact_median, number_rows, with_positions
from fragsql.operators.rolling import rolling_totals
from fragsql.operators.spikes import clock_fault, measurement_faults, phase_space_faults, phase_space_spikes
from fragsql.queries import problems
from fragsql.runtime import staged_tables


@pytest.mark.parametrize("name", sorted(problems.SQL))
def test_against_sql(spark, data, duck, name):
    same(problems.QUERIES[name](spark, data), duck, problems.SQL[name])


def test_eager_join_equals_plain_join(spark):
    rnd = random.Random(1)
    left = spark.createDataFrame([(rnd.choice(["hot"] * 9 + ["a", "b", None]), rnd.choice("xy"), rnd.randrange(9), 1) for _ in range(300)], "k string, g string, v int, clash int")
    right = spark.createDataFrame([(rnd.choice(["hot"] * 5 + ["a", "c", None]), rnd.choice("xy"), rnd.randrange(9), 2) for _ in range(60)], "k string, g string, w int, clash int")
    plain = left.join(right, ["k", "g"]).groupBy("k").agg(F.count("*").alias("n_joined"), F.sum("v").alias("sv"), F.sum("w").alias("sw"), F.max("v").alias("mv"))
    eager = eager_join_aggregate(left, right, ["k", "g"], {"sv": ("sum", "v"), "mv": ("max", "v")}, {"sw": ("sum", "w")}, rollup=["k"])
    assert sorted(eager.select("k", "n_joined", "sv", "sw", "mv").collect()) == sorted(plain.select("k", "n_joined", "sv", "sw", "mv").collect())


def test_eager_join_outer_empty_and_errors(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    none = left.where("false").withColumnRenamed("v", "w")
    row = eager_join_aggregate(left, none, ["k"], {"s": ("sum", "v")}, {"t": ("sum", "w")}, how="left").first()
    assert (row["k"], row["n_joined"], row["s"], row["t"]) == ("a", 2, 3, None)
    assert eager_join_aggregate(left, none, ["k"]).count() == 0
    with pytest.raises(ValueError):
        eager_join_aggregate(left, none, ["k"], {"d": ("distinct", "v")}, rollup=[])
    with pytest.raises(ValueError):
        eager_join_aggregate(left, none, ["k"], {"s": ("sum", "v")}, {"s": ("sum", "w")})


def test_hot_keys_are_combined_before_the_exchange(spark, data):
    plan = problems.p2_found(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rolling_totals_by_hand(spark):
    df = spark.createDataFrame([("a", 10, 5, 0), ("a", 10, 1, 0), ("a", 12, None, 0), ("b", 40, 2, 0), (None, 11, 7, 0), ("a", None, 7, 0)], "e string, d int, v int, total int")
    got = {(r["e"], r["d"]): r for r in rolling_totals(df, "e", "d", "v", periods=(2, 3)).collect()}
    assert len(got) == 2 * 31
    assert [got["a", d]["total_2"] for d in (10, 11, 12)] == [6, 6, 0]
    assert [got["a", d]["total_3"] for d in (10, 11, 12, 13)] == [6, 6, 6, 0]
    assert got["a", 11]["avg_2"] == 3.0 and got["b", 39]["total_3"] == 0 and got["b", 40]["total"] == 2
    rows = {(r["e"], r["d"]): r["total_3"] for r in rolling_totals(df, "e", "d", periods=(3,), first=11, last=13).collect()}
    assert rows["a", 13] == 1 and rows["a", 11] == 0 and len(rows) == 3
    assert rolling_totals(df.where("false"), "e", "d").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_and_median(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.randrange(1000), float(rnd.randrange(20))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, v double").repartition(6)
    got = with_positions(df, ["g"], ["t"]).collect()
    for g in ("hot", "b", None):
        mine = sorted((r["pos"], r["t"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        assert [t for _, t in mine] == sorted(t for x, t, _ in rows if x == g)
        assert {r["n"] for r in got if r["g"] == g} == {len(mine)}
    meds = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert meds == {g: median(v for x, _, v in rows if x == g) for g in ("hot", "b", None)}
    assert exact_median(df.where("false"), ["g"], "v").count() == 0
    assert with_positions(df.where("false"), ["g"], ["t"]).count() == 0
    with pytest.raises(ValueError):
        with_positions(df.withColumnRenamed("v", "pos"), ["g"], ["t"])


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.0, 1.0000001, -1e308, 1e-300, float("inf")]), st.floats(-5, 5))), max_size=60))
@settings(max_examples=3, deadline=None)
def test_median_of_any_numbers(spark, rows):
    got = {r["g"]: r["m"] for r in exact_median(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", "m").collect()}
    want = {g: [v for x, v in rows if x == g and v is not None] for g in {g for g, _ in rows}}
    assert {g: m + 0.0 for g, m in got.items()} == {g: median(vs) + 0.0 for g, vs in want.items() if vs}


def test_median_of_a_hot_value_keeps_partitions_even(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.lit("node").alias("g"), F.when(F.col("id") % 10 != 0, 0.0).otherwise(F.rand(1)).alias("v"))
    assert [r["median"] for r in exact_median(df, ["g"], "v").collect()] == [0.0]
    # of the 36,000 equal values a row a task moves, and one is left to be sorted
    near = [t for _, t in staged_tables() if "fragsql-near" in t]
    assert spark.read.parquet(near[-1]).count() == 1


def test_rows_are_numbered_in_their_order(spark):
    df = spark.range(0, 1000, 1, 7).orderBy(F.col("id").desc())
    assert [r["row"] for r in number_rows(df).orderBy(F.col("id").desc()).collect()] == list(range(1, 1001))
    assert number_rows(df.where("false")).count() == 0


def brute_faults(rows):
    """The fixed rules, one series at a time."""
    out = set()
    for src in {r[1] for r in rows}:
        series = {}
        for i, s, t, v in rows:
            if s == src and t is not None and v is not None:
                if not (0 <= v <= 1):
                    out.add((i, "impossible"))
                else:
                    series[t] = max(v, series.get(t, -1))
        ts = sorted(series)
        vs = [series[t] for t in ts]
        usual = median([abs(b - a) for a, b in zip(vs, vs[1:], strict=False)]) if len(vs) > 1 else None
        for p, t in enumerate(ts):
            a = p
            while a and vs[a - 1] == vs[p]:
                a -= 1
            b = p
            while b + 1 < len(vs) and vs[b + 1] == vs[p]:
                b += 1
            kind = None
            if vs[p] != 0 and b - a + 1 >= 10:
                kind = "still"
            elif usual is not None and abs(vs[p] - median(vs[max(0, p - 4) : p + 5])) > 8 * usual:
                kind = "jump"
            if kind:
                out |= {(i, kind) for i, s, x, v in rows if s == src and x == t and v is not None and 0 <= v <= 1}
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_measurement_faults_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, i = [], 0
    for src in ("a", "b", None):
        level = 0.4
        for t in range(300):
            i += 1
            level += rnd.uniform(-0.01, 0.01)
            v = level
            if t % 97 == 50:
                v = 0.99
            if 120 <= t < 120 + rnd.choice([9, 10, 14]):
                v = 0.25
            if t % 83 == 1:
                v = rnd.choice([float("nan"), math.inf, -0.1, 1.5, None])
            rows.append((i, src, t, v))
            if t % 50 == 0:
                i += 1
                rows.append((i, src, t, v))
    rows += [(i + 1, "a", None, 0.5), (i + 2, "one", 5, 0.5)]
    df = spark.createDataFrame(rows, "id long, s string, t long, v double").repartition(5)
    for block in (16, 4096):
        got = {(r["id"], r["fault"]) for r in measurement_faults(df, "id", "s", "t", ["v"], block=block).collect()}
        assert got == brute_faults(rows)


def test_clock_faults_and_empty(spark):
    df = spark.sql("""select * from values
      (1L, 'a', 1677628800000L, timestamp'2023-03-01 00:00:00', 0.5D), (2L, 'a', 1677632400001L, timestamp'2023-03-01 00:00:00', 9.0D),
      (3L, 'a', 1677628800000L - 2592000001L, timestamp'2023-03-01 00:00:00', 0.5D), (4L, 'a', 1L, null, 0.5D), (5L, 'a', null, timestamp'2023-03-01 00:00:00', 7.0D)
      as x(id, s, t, c, v)""")
    assert {r["id"] for r in df.where(clock_fault(df, "t", "c")).collect()} == {2, 3}
    ntz = df.withColumn("c", F.col("c").cast("timestamp_ntz"))
    assert {r["id"] for r in ntz.where(clock_fault(ntz, "t", "c")).collect()} == {2, 3}
    assert {tuple(r) for r in measurement_faults(df, "id", "s", "t", ["v"], "c").collect()} == {(2, "t", "clock"), (3, "t", "clock")}
    for f in (measurement_faults, phase_space_faults):
        assert f(df.where("false"), "id", "s", "t", ["v"], "c").count() == 0


def test_phase_space_of_short_and_flat_series():
    for v in ([], [1.0], [0.5] * 40, [0.0, 1.0, 0.0, 1.0]):
        assert not phase_space_spikes(np.array(v)).any()
    noise = np.random.default_rng(1).normal(0.3, 0.01, 2000)
    assert phase_space_spikes(noise).sum() <= 6
    noise[[3, 700, 701, 1999]] = 0.9
    assert set(np.flatnonzero(phase_space_spikes(noise))) >= {3, 700, 701}


def test_phase_space_finds_planted_spikes(spark):
    rnd = random.Random(5)
    rows, spikes = [], set()
    for src in ("a", "b"):
        for t in range(1500):
            v = 0.3 + 0.1 * math.sin(t / 200) + rnd.gauss(0, 0.004)
            if t % 211 == 100:
                v, _ = 0.95, spikes.add((src, t))
            rows.append((len(rows), src, t, v))
    rows += [(len(rows) + k, "zero", k, 0.0) for k in range(50)] + [(9000 + k, "stuck", k, 0.5) for k in range(20)] + [(9100, "stuck", 30, 7.0)]
    df = spark.createDataFrame(rows, "id long, s string, t long, v double")
    got = phase_space_faults(df, "id", "s", "t", ["v"], block=512, context=128).collect()
    at = {r[0]: (r[1], r[2]) for r in rows}
    found = {at[r["id"]] for r in got if r["fault"] == "spike"}
    assert spikes <= found and len(found - spikes) <= 6
    assert {r["id"] for r in got if r["fault"] == "still"} == set(range(9000, 9020))
    assert {r["id"] for r in got if r["fault"] == "impossible"} == {9100}
    assert not [r for r in got if at[r["id"]][0] == "zero"]


def test_phase_space_ellipsoids_are_those_of_the_whole_series(spark):
    rnd = np.random.default_rng(6)
    calm, noisy = rnd.normal(0.3, 0.002, 900), rnd.normal(0.3, 0.05, 300)
    v = np.clip(np.concatenate([calm, noisy, calm + 0.02]), 0.01, 0.99)
    v[[450, 511, 512, 1050, 1799, 1800, 1801, 2020]] = 0.95
    want = set(np.flatnonzero(phase_space_spikes(v)))
    df = spark.createDataFrame([(t, s, t, float(x)) for s in ("a", None) for t, x in enumerate(v)], "id long, s string, t long, v double").repartition(5)
    for block in (256, 1049, 4096):
        got = phase_space_faults(df, "id", "s", "t", ["v"], block=block, context=0).collect()
        assert sorted(r["id"] for r in got) == sorted([*want, *want])


@pytest.mark.parametrize("seed", range(5))
def test_phase_space_flags_the_ends_and_not_their_neighbours(seed):
    noise = np.random.default_rng(seed).normal(0.3, 0.01, 2000)
    for at in ([0, 3, 700, 1999], [1, 1998], [2, 1997], [0], [1999]):
        v = noise.copy()
        v[at] = 0.9
        found = set(np.flatnonzero(phase_space_spikes(v)))
        assert found >= set(at)
        assert not found & {k for a in at for k in (a - 1, a + 1)} - set(at)


def test_phase_space_goes_on_until_no_spike_is_new():
    rnd = np.random.default_rng(0)
    v = 0.3 + 0.002 * np.exp(rnd.normal(0, 1.5, 300))
    found = phase_space_spikes(v)
    assert found.sum() > phase_space_spikes(v, 10).sum()
    assert (found == phase_space_spikes(v, len(v))).all()


def test_phase_space_of_series_that_stand_still_mostly():
    v = np.full(200, 0.5)
    v[[50, 120, 199]] = 0.5001, 0.9, 0.4
    assert set(np.flatnonzero(phase_space_spikes(v))) == {50, 120, 199}
    levels = np.repeat([0.2, 0.4, 0.6], 100)  # values have a spread, differences have none
    levels[[30, 150]] += 0.01
    assert {30, 150} <= set(np.flatnonzero(phase_space_spikes(levels)))
    short = np.array([0.1, 0.1, 0.1, 0.9])  # why p5_found isn't derived from the method's marks
    assert not phase_space_spikes(short).any() and (3, "jump") in brute_faults([(i, "a", i, x) for i, x in enumerate(short)])


def test_phase_space_cannot_give_the_jumps_of_the_plain_rule(spark):
    """A load that shows two steps: its usual step is 0, so by the rule two of five readings jump, but quartiles count
    both levels as normal. No ellipsoid with quartile spreads leaves so many of its own readings outside."""
    rows = [(i, "a", i * 300_000, 0.5 if i % 5 > 2 else 0.2) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, node string, t long, v double")
    jumps = {r["id"] for r in measurement_faults(df, "id", "node", "t", ["v"]).collect()}
    marks = {r["id"] for r in phase_space_faults(df, "id", "node", "t", ["v"]).collect()}
    assert len(jumps) == 202 and not marks  # two of five, and two more at the ends
