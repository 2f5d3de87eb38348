import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalspark.operators import events, scans, series


def frame(spark):
    r = np.random.default_rng(4)
    rows = [(k, int(i), float(v) if r.random() > 0.1 else None) for k, n in (("a", 300), (None, 90), ("b", 1)) for i, v in zip(np.sort(r.choice(700, n, replace=False)), r.normal(size=n), strict=True)]
    return spark.createDataFrame([*rows, ("c", 5, None), ("c", 6, 2.0)], "k string, i long, x double")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_running_sums_do_not_depend_on_stretches(spark, size):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["k"], r["i"]): r["y"] for r in df.withColumn("y", F.sum("x").over(w)).collect()}
    got = scans.running_sum(df, ["k"], F.col("x"), "y", "i", size)
    assert got.columns == ["k", "i", "x", "y"]
    got = {(r["k"], r["i"]): r["y"] for r in got.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) if want[c] is not None else got[c] is None for c in want)


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("own", [False, True])
def test_nearest_values_over_stretches(spark, ahead, own):
    df = frame(spark).where("k is null or k <> 'b'").withColumn("m", F.when(F.col("i") % 9 == 0, F.struct("i", "x")))
    w, edge = Window.partitionBy("k").orderBy("i"), 0 if own else 1
    f = F.first("m", ignorenulls=True).over(w.rowsBetween(edge, Window.unboundedFollowing)) if ahead else F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -edge))
    want = {(r["k"], r["i"]): r["y"] for r in df.withColumn("y", f).collect()}
    for size in (4, 50, 1 << 16):
        assert {(r["k"], r["i"]): r["y"] for r in scans.nearest(df, ["k"], F.col("m"), "y", "i", ahead, own, size).collect()} == want


@pytest.mark.parametrize("size", [1, 5, 64])
def test_neighbours_do_not_depend_on_pieces(spark, size):
    df = frame(spark)

    def near(rows, keys, order):
        w = Window.partitionBy(*keys).orderBy(order)
        return rows.withColumn("y", F.collect_list(F.coalesce("x", F.lit(0.0))).over(w.rowsBetween(-3, 2))).withColumn("z", F.lag("x", 3).over(w))

    plain = {(r["k"], r["i"]): r for r in near(df, ["k"], "i").collect()}
    got = {(r["k"], r["i"]): r for r in scans.by_pieces(df, ["k"], "i", 3, 2, near, size, 50).collect()}
    assert got == plain
    assert scans.by_pieces(df.limit(0), ["k"], "i", 3, 2, near, size).count() == 0


def test_one_long_channel_runs_on_many_tasks(spark):
    df = spark.range(0, 1_000_000, 1, 4).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") % 7 - 3).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = series.box_smooth(series.walk(df, ["k"]).select("k", "i", F.col("y").alias("x")), ["k"], 5)
        used = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(used) > 2 and sum(r["count"] for r in used) == 1_000_000
    x = np.arange(1_000_000) % 7 - 3.0
    want = np.convolve(np.cumsum(x - x.mean()), np.ones(5))[2:-2] / 5
    got = out.where("i % 99991 < 3").select("i", "y").collect()
    assert len(got) > 30 and all(r["y"] == pytest.approx(want[r["i"]], abs=1e-6) for r in got)


def plain_marks(rows):
    """[(first, last, middle, value, kind)] and places before a crossing of sorted rows (i, x)."""
    runs, cross = [], []
    for k, (i, x) in enumerate(rows):
        if k and x is not None and rows[k - 1][1] is not None and (x > 0) != (rows[k - 1][1] > 0):
            cross.append(rows[k - 1][0])
        if runs and x is not None and runs[-1][2] == x:
            runs[-1][1] = i
        else:
            runs.append([i, i, x])
    out = []
    for (_, _, p), (a, b, x), (_, _, n) in zip(runs, runs[1:], runs[2:], strict=False):
        if None not in (p, x, n) and (x > p) == (x > n) and (x < p) == (x < n):
            out.append((a, b, (a + b) // 2, x, "peak" if x > p else "trough"))
    return out, cross


@pytest.mark.parametrize("size", [1, 3, 8, 50, 1 << 16])
def test_extrema_crossings_and_phases_do_not_depend_on_stretches(spark, size):
    r = np.random.default_rng(7)
    rows = [(k, i, None if r.random() < gap else float(v)) for k, n, most, gap in (("a", 120, 2, 0), (None, 60, 3, 0.05), ("b", 90, 1, 0), ("c", 40, 9, 0.02), ("d", 1, 2, 0), ("e", 30, 0, 0)) for i, v in enumerate(r.integers(-most, most + 1, n))]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(3)
    want, phases, peaks = set(), {}, set()
    for k in ("a", None, "b", "c", "d", "e"):
        own = [(i, x) for key, i, x in rows if key == k]
        found, cross = plain_marks(own)
        want |= {(k, m, x, kind) for _, _, m, x, kind in found}
        for i, _ in own:
            last = [f for f in found if f[2] <= i][-1:]
            after = [f for f in found if f[2] > i][:1]
            base = 0.5 if last and last[0][4] == "peak" else 0.0
            phases[k, i] = base + 0.5 * (i - last[0][2]) / (after[0][2] - last[0][2]) if last and after else None
        for n, (a, b, m, x, kind) in enumerate(found):
            start = max([c for c in cross if c < a][-1:] + [f[2] for f in found[:n]][-1:] + [0])
            stop = min([c for c in cross if c >= b][:1] + [f[2] for f in found[n + 1 :]][:1] + [len(own) - 1])
            inside = [v for i, v in own if start < i <= stop and v is not None]
            if kind == "peak" and 5 < m < 80 and k is not None:
                peaks.add((k, m, x, start, stop, sum(inside) if inside else None))
    assert {tuple(r) for r in series.local_extrema(df, ["k"], size=size).collect()} == want
    got = events.phase(df, ["k"], size=size).collect()
    assert len(got) == len(rows) and all(r["phase"] == (pytest.approx(p) if (p := phases[r["k"], r["i"]]) is not None else None) for r in got)
    got = events.evoked_peaks(df, ["k"], "peak", (5, 80), size=size)
    assert got.columns == ["k", "at", "amplitude", "start", "stop", "area"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(peaks, key=str)


def test_slow_waves_do_not_depend_on_stretches(spark):
    df = spark.range(700).select(F.lit("a").alias("k"), F.col("id").alias("i"), (60 * F.sin(F.col("id") * 0.9) + 30 * F.sin(F.col("id") * 0.41)).alias("x"))
    limits = (4.0, (20, 300), (10, 300), (40, 700), (0.3, 1.5), (0.1, 1.5))
    few = [sorted(tuple(r) for r in events.slow_waves(df, ["k"], *limits, size=s).collect()) for s in (9, 64, 1 << 16)]
    assert few[0] == few[1] == few[2] and len(few[0]) > 20


def test_extrema_read_their_input_twice_at_most(spark):
    df = frame(spark).repartition(3)
    for out, most in ((series.local_extrema(df, ["k"]), 2), (events.phase(df, ["k"]), 2), (events.evoked_peaks(df, ["k"], "peak", (5, 80)), 8)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") <= most
