"""Faulty measurements per source: impossible times and values, readings that stand still, jumps and spikes.

Series are cut by position, not by source: positions come from one range shuffle (operators/positions.py), blocks of
BLOCK readings carry a few readings of their neighbours along, and every window works on one block. A source with a
third of all rows is therefore no larger a task than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragsql.operators.positions import exact_median, with_positions
from fragsql.runtime import bounded_broadcast, stage

BLOCK = 4096
HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def millis(df: DataFrame, column: str) -> Column:
    """Milliseconds since 1970 of a timestamp column; one without time zone is taken as UTC whatever the session's zone."""
    c = F.col(column)
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_millis(c)
    part = F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)
    return F.unix_date(c.cast("date")).cast("long") * F.lit(DAY_MS) + part.cast("long") * F.lit(1000) + F.floor(F.extract(F.lit("SECOND"), c) * F.lit(1000)).cast("long")


def clock_fault(df: DataFrame, time: str, seen: str, ahead_ms: int = HOUR_MS, behind_ms: int = 30 * DAY_MS) -> Column:
    """True if `time` (ms) lies further after or before the timestamp `seen` than allowed; false if either is null."""
    gap = F.col(time) - millis(df, seen)
    return F.coalesce((gap > ahead_ms) | (gap < -behind_ms), F.lit(False))


def _possible(v: Column, low: float, high: float) -> Column:
    return (v >= low) & (v <= high)  # false for NaN, which sorts above every number


def _series(df: DataFrame, source: str, time: str, fields: Sequence[str], low: float, high: float) -> DataFrame:
    """src, field, t, v, pos, n: the possible readings, one per source, time and field, with their positions."""
    once = df.where(F.col(time).isNotNull()).groupBy(F.col(source).alias("src"), F.col(time).alias("t")).agg(*[F.max(F.col(f).cast("double")).alias(f"__v{i}") for i, f in enumerate(fields)])
    long = once.select("src", "t", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__v{i}").alias("v")) for i, f in enumerate(fields)])).alias("r"))
    return with_positions(long.select("src", F.col("r.field").alias("field"), "t", F.col("r.v").alias("v")).where(_possible(F.col("v"), low, high)), ["src", "field"], ["t"])


def _blocks(series: DataFrame, halo: int, block: int) -> DataFrame:
    """Each reading once in its own block (core) and once more in a neighbouring block it lies within `halo` of."""
    at = F.col("pos") - 1
    home = F.floor(at / F.lit(block))
    near = F.sequence(F.greatest(F.floor((at - halo) / F.lit(block)), F.lit(0)), F.floor((at + halo) / F.lit(block)))
    return series.withColumn("block", F.explode(near)).withColumn("core", F.col("block") == home)


def _row_faults(df: DataFrame, id_: str, clock: Column, fields: Sequence[str], time: str, low: float, high: float) -> DataFrame:
    """Faults judged row by row, null where there is none."""
    each = [F.when(clock, F.struct(F.lit(time).alias("field"), F.lit("clock").alias("fault")))]
    each += [F.when(~clock & F.col(f).isNotNull() & F.col(time).isNotNull() & ~_possible(F.col(f).cast("double"), low, high), F.struct(F.lit(f).alias("field"), F.lit("impossible").alias("fault"))) for f in fields]
    return df.select(F.col(id_).alias("id"), F.explode(F.array_compact(F.array(*each))).alias("r")).select("id", "r.field", "r.fault")


def _spread_to_rows(df: DataFrame, flagged: DataFrame, id_: str, source: str, time: str, fields: Sequence[str]) -> DataFrame:
    """All rows of the flagged readings (src, field, t, fault); a row whose own value is null isn't one of them."""
    rows = df.select(F.col(id_).alias("id"), F.col(source).alias("__s"), F.col(time).alias("__t"), F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).isNotNull())]).alias("has"))
    return rows.join(flagged, rows["__s"].eqNullSafe(flagged["src"]) & (rows["__t"] == flagged["t"])).where(F.col("has")[F.col("field")]).select("id", "field", "fault")


def measurement_faults(
    df: DataFrame,
    id_: str,
    source: str,
    time: str,
    fields: Sequence[str],
    seen: str | None = None,
    low: float = 0.0,
    high: float = 1.0,
    still: int = 10,
    steps: float = 8.0,
    reach: int = 4,
    block: int = BLOCK,
) -> DataFrame:
    """id, field, fault of every faulty reading by fixed rules, exactly.

    clock: `time` more than an hour after or 30 days before `seen`; such rows take no further part.
    impossible: NaN, infinite or outside low..high; such values take no further part.
    still: one of at least `still` consecutive readings of the source with the very same value other than 0.
    jump: not still, and more than `steps` usual steps from the median of the readings within `reach` places on
    either side; the usual step is the exact median absolute difference of the source's consecutive readings.

    Rows with the same source and time are one reading (of differing values the largest counts); a faulty reading
    gives a row for each of them. Null values and rows without time are left out, a null `seen` is no fault, rows
    without source form a series of their own. An empty df gives no rows; other columns are ignored.
    """
    clock = clock_fault(df, time, seen) if seen else F.lit(False)
    good = df.where(~clock)
    series = _series(good, source, time, fields, low, high)
    w = Window.partitionBy("src", "field", "block").orderBy("pos")
    keep = ["src", "field", "block", "core", "pos", "t", "v"]
    before = F.lag("v").over(w)
    work = _blocks(series, max(still, reach + 1), block).select(
        *keep,
        F.array_sort(F.collect_list("v").over(w.rowsBetween(-reach, reach))).alias("near"),
        F.abs(F.col("v") - before).alias("step"),
        F.when(F.col("v") == before, 0).otherwise(1).alias("new"),
    )
    middle = lambda i: F.element_at("near", F.floor(i).cast("int"))
    work = work.select(
        *keep,
        "step",
        ((middle((F.size("near") + 1) / 2) + middle(F.size("near") / 2 + 1)) / 2).alias("mid"),
        F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
    )
    # a run of this length within a block and its halo is one of at least this length
    alike = F.count(F.lit(1)).over(Window.partitionBy("src", "field", "block", "run"))
    work = work.withColumn("still", (F.col("v") != 0) & (alike >= still))
    work = stage(work.where("core").select("src", "field", "t", "v", "mid", "step", "still"), "readings")
    usual = stage(exact_median(work, ["src", "field"], "step", "usual").select(F.col("src").alias("__src"), F.col("field").alias("__field"), "usual"), "usual")
    judged = work.join(bounded_broadcast(usual), F.col("src").eqNullSafe(F.col("__src")) & (F.col("field") == F.col("__field")), "left")
    jump = F.abs(F.col("v") - F.col("mid")) > F.lit(steps) * F.col("usual")
    flagged = judged.select("src", "field", "t", F.when(F.col("still"), "still").when(jump, "jump").alias("fault")).where(F.col("fault").isNotNull())
    out = _row_faults(df, id_, clock, fields, time, low, high).unionAll(_spread_to_rows(good, flagged, id_, source, time, fields))
    return out.withColumnRenamed("id", id_)


def _points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second differences of a series, and how much it bends at each reading.

    At the ends they are one-sided; the outermost readings have no second difference (0). A spike of height h bends its own place by 2h and the places beside it by h; the
    bend at an end is 1.5 times its step, so that a spike there counts more than its neighbour and a neighbour's less.
    """
    n = len(x)
    if n < 3:  # a block of one reading and less than two beside it is never judged
        return np.zeros(n), np.zeros(n), np.zeros(n)
    d1, d2, bend = np.zeros(n), np.zeros(n), np.zeros(n)
    d1[1:-1] = (x[2:] - x[:-2]) / 2
    d1[0], d1[-1] = (x[1] - x[0]) / 2, (x[-1] - x[-2]) / 2
    curve = x[2:] - 2 * x[1:-1] + x[:-2]
    d2[2:-2] = (x[4:] - 2 * x[2:-2] + x[:-4]) / 4
    d2[1], d2[-2] = curve[0] / 4, curve[-1] / 4
    bend[1:-1] = np.abs(curve)
    bend[0], bend[-1] = 1.5 * abs(x[1] - x[0]), 1.5 * abs(x[-1] - x[-2])
    return d1, d2, bend


def _peaks_outside(x: np.ndarray, d1: np.ndarray, d2: np.ndarray, bend: np.ndarray, quartiles: np.ndarray, slope: float, n: int) -> np.ndarray:
    """Which readings lie outside the ellipsoid of a series of n and bend it no less than both their neighbours.

    quartiles has a line for each quarter and a column for each of x, d1 and d2.
    """
    low, mid, high = quartiles
    sx, s1, s2 = ((high - low) / 1.349) ** 2
    dx, angle = x - mid[0], np.arctan(slope)
    if sx == 0 or s2 == 0:  # a flat ellipse isn't turned
        angle = 0.0
    cos, sin = np.cos(angle), np.sin(angle)
    det = cos**4 - sin**4
    a, b = ((sx * cos**2 - s2 * sin**2) / det, (s2 * cos**2 - sx * sin**2) / det) if abs(det) > 1e-9 else (sx, s2)
    radius = np.zeros(len(x))
    for y, s in ((dx * cos + d2 * sin, a), (d1, s1), (d2 * cos - dx * sin, b)):
        if s > 0:
            radius += y**2 / s
        elif s == 0:
            radius[y != 0] = np.inf
    around = np.pad(bend, 1, constant_values=-np.inf)
    return (radius > 2 * np.log(n)) & (bend >= np.maximum(around[:-2], around[2:]))


def _rounds(most: int | None) -> Iterable[int]:
    return count() if most is None else range(most)


def phase_space_spikes(v: np.ndarray, max_iterations: int | None = None) -> np.ndarray:
    """Which readings of one series are spikes, by robust ellipsoids in phase space.

    A reading is a point (value, first difference, second difference). The ellipsoid of normal behaviour has its
    centre at the median, its spreads are interquartile ranges / 1.349, its axes in the plane of value and second
    difference are turned by their regression angle, its semi-axes are sqrt(2 ln n) spreads. A point outside is a
    spike if it bends the series no less than both its neighbours, which a spike drags outside with it. Spikes are
    replaced by a line between the good readings around them and the ellipsoid is found again, until no new spike
    appears (every round but the last marks one) or, if given, after max_iterations. In a direction in which the series has no spread, any deviation lies
    outside; one whose turned spread comes out negative, which no ellipse has, isn't judged in that round.
    """
    n, spike = len(v), np.zeros(len(v), bool)
    x = v.astype(np.float64)
    if n < 5:
        return spike
    for _ in _rounds(max_iterations):
        d1, d2, bend = _points(x)
        var = x.var()
        slope = np.cov(x, d2, bias=True)[0, 1] / var if var > 0 else 0.0
        fresh = _peaks_outside(x, d1, d2, bend, np.percentile(np.stack([x, d1, d2]), [25, 50, 75], axis=1), slope, n) & ~spike
        if not fresh.any():
            break
        spike |= fresh
        good = np.flatnonzero(~spike)
        if not len(good):
            break
        at = np.flatnonzero(spike)
        x[at] = np.interp(at, good, v[good])
    return spike


def _each_block(blocks: DataFrame, f: Callable[[dict], pa.Table], schema: str) -> DataFrame:
    """f of every row of blocks; lists come as numpy arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                yield from f({c: x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else x for c, x in row.items()}).to_batches()

    return blocks.mapInArrow(run, schema)


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    values = pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _again(scalar: pa.Scalar, n: int) -> pa.Array:
    return pa.repeat(scalar, n)


def _edges(row: dict) -> pa.Table:
    """The readings of a block that others may need: the outermost two, and the outermost good ones of the rest, on either side."""
    v, spike, n = row["v"], row["spike"], len(row["v"])
    inner = np.flatnonzero(~spike[2:-2])[[0, -1]] + 2 if n > 4 and not spike[2:-2].all() else []
    at = np.unique(np.r_[0, min(1, n - 1), max(n - 2, 0), n - 1, inner].astype(int))
    same = {c: _again(row[c], len(at)) for c in ("src", "field", "block")}
    return pa.table(same | {"at": pa.array(at + row["start"].as_py()), "v": pa.array(v[at]), "spike": pa.array(spike[at])})


def _neighbours(part: pa.Table) -> pa.Table:
    """For each block of one series, the two readings beyond either end of it and the nearest good ones beyond those."""
    part = part.sort_by("at")
    at, v, spike, block = (part[c].to_numpy() for c in ("at", "v", "spike", "block"))
    place, m = np.arange(len(at)), len(at)
    before = np.maximum.accumulate(np.where(spike, -1, place))
    after = np.minimum.accumulate(np.where(spike, m, place)[::-1])[::-1]
    begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    near = []
    for i, j in zip(begins, np.append(begins[1:], m), strict=True):
        left = [before[i - 3]] if i >= 3 else []
        right = [after[j + 2]] if j + 2 < m else []
        near.append(np.array([k for k in (*left, i - 2, i - 1, j, j + 1, *right) if 0 <= k < m], int))
    lists = {f"near_{c}": pa.array([x[k] for k in near], pa.list_(kind)) for c, x, kind in (("at", at, pa.int64()), ("v", v, pa.float64()), ("spike", spike, pa.bool_()))}
    same = {f"__{c}": part[c].take(pa.array(begins)) for c in ("src", "field", "block")}
    return pa.table(same | lists)


def _filled(row: dict) -> tuple[np.ndarray, int]:
    """A block's readings, and up to two beyond either end, with spikes replaced by lines; how many come before the block."""
    start, n, near = row["start"].as_py(), len(row["v"]), row["near_at"]
    cut = np.searchsorted(near, start)
    join = lambda c, x: np.concatenate([row[f"near_{c}"][:cut], x, row[f"near_{c}"][cut:]])
    at, x, spike = join("at", np.arange(start, start + n)), join("v", row["v"]), join("spike", row["spike"]).astype(bool)
    if spike.any() and not spike.all():
        x[spike] = np.interp(at[spike], at[~spike], x[~spike])
    keep = (at >= start - 2) & (at < start + n + 2)
    return x[keep], int(np.count_nonzero(at[keep] < start))


def _block_points(row: dict) -> pa.Table:
    x, skip = _filled(row)
    core = slice(skip, skip + len(row["v"]))
    same = {c: _again(row[c], len(row["v"])) for c in ("src", "field")}
    d1, d2, _ = _points(x)
    return pa.table(same | {"x": x[core], "d1": d1[core], "d2": d2[core]})


def _block_marks(row: dict) -> pa.Table:
    """The block with its fresh spikes."""
    x, skip = _filled(row)
    spike = row["spike"].astype(bool)
    fresh = _peaks_outside(x, *_points(x), row["quartiles"].reshape(3, 3), row["slope"].as_py(), row["n"].as_py())[skip : skip + len(spike)] & ~spike
    same = {c: _again(row[c], 1) for c in ("src", "field", "block", "start", "n")}
    lists = {c: _list(row[c]) for c in ("t", "v", "stuck")}
    return pa.table(same | lists | {"spike": _list(spike | fresh), "fresh": [int(fresh.sum())]})


def _quartiles(points: DataFrame) -> DataFrame:
    """__src, __field, quartiles: those of x, d1 and d2, exactly, interpolated like numpy's: three lines of three."""
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("y")) for i, c in enumerate(("x", "d1", "d2"))])
    at = with_positions(points.select("src", "field", F.explode(each).alias("r")).select("src", "field", "r.c", "r.y"), ["src", "field", "c"], ["y"])
    place = F.struct(*[((F.col("n") - 1) * F.lit(q / 4)).alias(f"q{q}") for q in (1, 2, 3)])
    # a quarter lies between two positions, and each of them counts by its nearness
    near = lambda q: F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("pos") - 1 - F.col("at")[f"q{q}"]))
    at = at.withColumn("at", place).select("src", "field", "c", "y", *[near(q).alias(f"q{q}") for q in (1, 2, 3)]).where("q1 + q2 + q3 > 0")
    line = at.groupBy("src", "field", "c").agg(*[F.sum(F.col("y") * F.col(f"q{q}")).alias(f"q{q}") for q in (1, 2, 3)])
    one = lambda q: [F.max(F.when(F.col("c") == i, F.col(f"q{q}"))) for i in range(3)]
    return line.groupBy(F.col("src").alias("__src"), F.col("field").alias("__field")).agg(F.array(*one(1), *one(2), *one(3)).alias("quartiles"))


def _spikes_of_blocks(blocks: DataFrame, max_iterations: int | None) -> DataFrame:
    """phase_space_spikes of series cut into blocks (src, field, block, start, n, t, v, stuck, spike; a row each).

    Centre, spreads, angle and n are those of the whole series in every round: quartiles come from positions in a
    range-partitioned sort, the angle from mergeable sums. Of its neighbours a block gets only what differences and
    lines at its ends need; these few readings of each block are the only ones brought together per series.
    """
    kind, done = dict(blocks.dtypes), None
    row = ", ".join(f"{c} {kind[c]}" for c in ("src", "field", "block", "start", "n", "t", "v", "stuck", "spike"))
    mine = lambda *more: F.col("src").eqNullSafe(F.col("__src")) & (F.col("field") == F.col("__field")) & (F.col("block") == F.col("__block") if more else F.lit(True))
    for _ in _rounds(max_iterations):
        edges = _each_block(blocks, _edges, f"src {kind['src']}, field string, block bigint, at bigint, v double, spike boolean")
        near = edges.groupBy("src", "field").applyInArrow(_neighbours, f"__src {kind['src']}, __field string, __block bigint, near_at array<bigint>, near_v array<double>, near_spike array<boolean>")
        beside = blocks.join(bounded_broadcast(stage(near, "near")), mine("block")).drop("__src", "__field", "__block")
        points = stage(_each_block(beside, _block_points, f"src {kind['src']}, field string, x double, d1 double, d2 double"), "points")
        slope = points.groupBy(F.col("src").alias("__s"), F.col("field").alias("__f")).agg(F.coalesce(F.try_divide(F.covar_pop("x", "d2"), F.var_pop("x")), F.lit(0.0)).alias("slope"))
        shape = _quartiles(points).join(slope, F.col("__src").eqNullSafe(F.col("__s")) & (F.col("__field") == F.col("__f"))).drop("__s", "__f")
        judged = beside.join(bounded_broadcast(stage(shape, "shape")), mine()).drop("__src", "__field")
        judged = stage(_each_block(judged, _block_marks, row + ", fresh bigint"), "judged")
        busy = stage(judged.groupBy(F.col("src").alias("__src"), F.col("field").alias("__field")).agg(F.sum("fresh").alias("__fresh")).where("__fresh > 0"), "busy")
        calm = judged.join(bounded_broadcast(busy), mine(), "left_anti").drop("fresh")
        done = calm if done is None else done.unionAll(calm)
        blocks = judged.join(bounded_broadcast(busy), mine(), "left_semi").drop("fresh")
        if not busy.limit(1).count():
            break
    return blocks if done is None else done.unionAll(blocks)


def phase_space_faults(
    df: DataFrame,
    id_: str,
    source: str,
    time: str,
    fields: Sequence[str],
    seen: str | None = None,
    low: float = 0.0,
    high: float = 1.0,
    still: int = 10,
    max_iterations: int | None = None,
    block: int = 2 * BLOCK,
    context: int = 0,
) -> DataFrame:
    """id, field, fault with spikes found by phase-space thresholding; clock, impossible and still as above.

    The ellipsoids are those of a source's whole series at any length; a series of up to `block` readings is judged in
    one task, a longer one in blocks that carry max(still, context) readings of their neighbours along, with the same
    result. Zero-difference runs are `still`.

    Nulls, repeated readings, an empty df and other columns are treated as in measurement_faults.
    """
    clock = clock_fault(df, time, seen) if seen else F.lit(False)
    good = df.where(~clock)
    work = _blocks(_series(good, source, time, fields, low, high), max(context, still), block).select("src", "field", "block", "t", "v", "pos", "n", "core")

    def judge(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        v, n = part["v"].to_numpy(), part["n"][0].as_py()
        begins = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        runs = np.diff(np.append(begins, len(v)))
        stuck = (np.repeat(runs, runs) >= still) & (v != 0)
        keep = part["core"].to_numpy()
        whole = n <= block
        spike = phase_space_spikes(v, max_iterations) if whole and keep.any() else np.zeros(len(v), bool)
        if whole:  # nothing but its faults is needed any more
            keep = keep & (stuck | spike)
        start = part["pos"].to_numpy()[keep][:1] - 1
        out = part.slice(0, len(start)).select(["src", "field", "block", "n"])
        lists = {"t": part["t"].combine_chunks().filter(pa.array(keep)), "v": v[keep], "stuck": stuck[keep], "spike": spike[keep]}
        out = out.append_column("start", pa.array(start))
        for c, x in lists.items():
            out = out.append_column(c, _list(x).slice(0, len(start)))
        return out.select(["src", "field", "block", "start", "n", "t", "v", "stuck", "spike"])

    kind = dict(work.dtypes)
    schema = f"src {kind['src']}, field string, block bigint, start bigint, n bigint, t array<{kind['t']}>, v array<double>, stuck array<boolean>, spike array<boolean>"
    blocks = stage(work.groupBy("src", "field", "block").applyInArrow(judge, schema), "blocks")
    long = blocks.where(F.col("n") > block)
    if long.limit(1).count():
        blocks = blocks.where(F.col("n") <= block).unionAll(_spikes_of_blocks(long, max_iterations))
    each = blocks.select("src", "field", F.explode(F.arrays_zip("t", "stuck", "spike")).alias("r"))
    flagged = each.select("src", "field", "r.t", F.when(F.col("r.stuck"), "still").when(F.col("r.spike"), "spike").alias("fault")).where(F.col("fault").isNotNull())
    out = _row_faults(df, id_, clock, fields, time, low, high).unionAll(_spread_to_rows(good, flagged, id_, source, time, fields))
    return out.withColumnRenamed("id", id_)
