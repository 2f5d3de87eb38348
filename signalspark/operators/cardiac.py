"""Beat-to-beat and respiratory measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.functions.arrays import let, mean
from signalspark.operators.joins import range_join
from signalspark.operators.series import by_order


def hrv_time(beats: DataFrame, keys: list[str], order: str, rr: str = "rr") -> DataFrame:
    """(keys, n, mean_rr, sdnn, rmssd, pnn50) of intervals in ms."""
    d = beats.withColumn("step", F.col(rr) - F.lag(rr).over(by_order(keys, order)))
    share = F.count_if(F.abs("step") > 50) / F.count("step") * 100
    return d.groupBy(*keys).agg(
        F.count(rr).alias("n"), F.avg(rr).alias("mean_rr"), F.stddev_samp(rr).alias("sdnn"), F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("rmssd"), F.when(F.count("step") > 0, share).alias("pnn50")
    )


def _poincare_columns(rr: str):
    """sd1, sd2, csi and cvi from stddev_samp of the intervals and of their differences; null below five beats."""
    half = 0.5 * F.pow(F.stddev_samp("step"), F.lit(2))
    rest = 2 * F.pow(F.stddev_samp(rr), F.lit(2)) - half
    return half, rest


def poincare(beats: DataFrame, keys: list[str], order: str, rr: str = "rr") -> DataFrame:
    """(keys, sd1, sd2, csi, cvi); null with fewer than five beats, sd2 null if its square is not positive."""
    d = beats.withColumn("step", F.lead(rr).over(by_order(keys, order)) - F.col(rr))
    half, rest = _poincare_columns(rr)
    out = d.groupBy(*keys).agg(F.count(rr).alias("n"), F.sqrt(half).alias("sd1"), F.when(rest > 0, F.sqrt(rest)).alias("sd2"))
    out = out.where("n >= 5").withColumn("csi", F.try_divide("sd2", "sd1")).withColumn("cvi", F.when(F.col("sd1") * F.col("sd2") > 0, F.log10(F.col("sd1") * F.col("sd2"))))
    return out.drop("n")


def sliding_poincare(beats: DataFrame, keys: list[str], width: float, step: float, t: str = "t", rr: str = "rr") -> DataFrame:
    """(keys, start, sd1, sd2, csi, cvi) in windows [start, start + width] from the first beat on, every ``step``.

    Differences are taken inside each window; windows with fewer than five beats are left out."""
    ends = beats.groupBy(*keys).agg(F.min(t).alias("a"), F.max(t).alias("b")).where(F.col("b") - F.col("a") >= width)
    starts = ends.select(*keys, "a", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a") - width) / step))).alias("k"))
    starts = starts.select(*keys, (F.col("a") + F.col("k") * step).alias("start")).withColumn("stop", F.col("start") + width)
    inside = range_join(beats, starts, t, "start", "stop", width, keys)
    return poincare(inside, [*keys, "start"], t, rr)


def quadrants(beats: DataFrame, keys: list[str], order: str, rr: str = "rr") -> DataFrame:
    """(keys, quadrant, n, mean_x, mean_y, spread): successive differences by quadrant of the second-order plot."""
    w = by_order(keys, order)
    d = beats.withColumn("px", F.col(rr) - F.lead(rr).over(w)).withColumn("py", F.lead(rr).over(w) - F.lead(rr, 2).over(w)).where("py is not null")
    x, y = F.col("px"), F.col("py")
    q = F.when((x >= 0) & (y >= 0), 1).when((x < 0) & (y > 0), 2).when((x <= 0) & (y <= 0), 3).when((x > 0) & (y < 0), 4)
    d = d.withColumn("quadrant", q).where("quadrant is not null").withColumn("radius", F.sqrt(x * x + y * y))
    return d.groupBy(*keys, "quadrant").agg(F.count("*").alias("n"), F.avg("px").alias("mean_x"), F.avg("py").alias("mean_y"), (2 * F.stddev_pop("radius")).alias("spread"))


def quadrant_summary(beats: DataFrame, keys: list[str], order: str, rr: str = "rr") -> DataFrame:
    """(keys, arrest, acceleration, entropy): Q2 - Q4, Q3 - Q1, and base-2 entropy of the shares. An empty
    quadrant counts as one point."""
    q = quadrants(beats, keys, order, rr).groupBy(*keys)
    n = {k: F.coalesce(F.max(F.when(F.col("quadrant") == k, F.col("n"))), F.lit(0)) for k in (1, 2, 3, 4)}
    out = q.agg(*(c.alias(f"n{k}") for k, c in n.items()))
    held = [F.greatest(F.lit(1), F.col(f"n{k}")) for k in (1, 2, 3, 4)]
    whole = held[0] + held[1] + held[2] + held[3]
    entropy = sum((-(h / whole) * F.log2(h / whole) for h in held[1:]), -(held[0] / whole) * F.log2(held[0] / whole))
    return out.select(*keys, (F.col("n2") - F.col("n4")).alias("arrest"), (F.col("n3") - F.col("n1")).alias("acceleration"), entropy.alias("entropy"))


#: Bands of heart rate variability in Hz.
HRV_BANDS = {"vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4), "vhf": (0.4, 0.5)}


def periodogram(beats: DataFrame, keys: list[str], order: list[str], step: float, top: float, rr: str = "rr") -> DataFrame:
    """(keys, f, p): Lomb-Scargle power of the intervals (ms) at f = step, 2 step, ... up to ``top`` Hz.

    A beat's time is the sum of the intervals up to it. One aggregate over beats times frequencies: the mean and the phase
    shift are taken out of its sums afterwards, so no second pass is needed. Null intervals are left out; keys with fewer
    than five beats have no rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = beats.where(F.col(rr).isNotNull()).select(*keys, F.col(rr).alias("y"), (F.sum(rr).over(w) / 1000).alias("at"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(int(top / step + 1e-9)))))
    angle = F.col("k") * F.lit(2 * math.pi * step) * F.col("at")
    sums = rows.groupBy(*keys, "k").agg(
        F.count("*").alias("n"), F.avg("y").alias("m"), F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s"),
        F.sum(F.col("y") * F.cos(angle)).alias("yc"), F.sum(F.col("y") * F.sin(angle)).alias("ys"), F.sum(F.cos(2 * angle)).alias("c2"), F.sum(F.sin(2 * angle)).alias("s2"),
    ).where("n >= 5")
    half = F.atan2("s2", "c2") / 2
    yc, ys = F.col("yc") - F.col("m") * F.col("c"), F.col("ys") - F.col("m") * F.col("s")
    even, odd = yc * F.cos(half) + ys * F.sin(half), ys * F.cos(half) - yc * F.sin(half)
    r = F.sqrt(F.col("c2") * F.col("c2") + F.col("s2") * F.col("s2"))
    power = F.coalesce(F.try_divide(even * even, F.col("n") + r), F.lit(0.0)) + F.coalesce(F.try_divide(odd * odd, F.col("n") - r), F.lit(0.0))
    return sums.select(*keys, (F.col("k") * step).alias("f"), power.alias("p"))


def hrv_frequency(beats: DataFrame, keys: list[str], order: list[str], step: float = 0.005, rr: str = "rr") -> DataFrame:
    """(keys, vlf, lf, hf, vhf, total, lf_hf, lf_share, peak): band powers of the periodogram by sums times ``step``, the ratio of low
    to high, the share of low in both, and the frequency of most power (the lowest of equal ones)."""
    p = periodogram(beats, keys, order, step, HRV_BANDS["vhf"][1], rr)
    power = {n: F.coalesce(F.sum(F.when((F.col("f") >= a - 1e-9) & (F.col("f") < b - 1e-9), F.col("p"))), F.lit(0.0)) * step for n, (a, b) in HRV_BANDS.items()}
    out = p.groupBy(*keys).agg(*(c.alias(n) for n, c in power.items()), F.max(F.struct("p", (-F.col("f")).alias("g"))).alias("most"))
    lf, hf = F.col("lf"), F.col("hf")
    ratios = [F.try_divide(lf, hf).alias("lf_hf"), F.try_divide(lf, lf + hf).alias("lf_share"), (-F.col("most.g")).alias("peak")]
    return out.select(*keys, *HRV_BANDS, (F.col("vlf") + lf + hf + F.col("vhf")).alias("total"), *ratios)


def recurrence(series: DataFrame, keys: list[str], order: list[str], radius: float, dimension: int = 3, delay: int = 1, least: int = 2, value: str = "rr") -> DataFrame:
    """(keys, n, recurrence_rate, determinism, mean_line, longest_line, line_entropy) of the delay vectors of a series.

    Two vectors recur if no coordinate differs by more than ``radius``. They are found by an equi-join on the first coordinate's
    bucket and its neighbours; diagonals of at least ``least`` are runs along equal distance in order. The work grows with the
    recurrences, so long series are cut into windows by ``keys``. Vectors with nulls and series of fewer than two vectors are left
    out; rates are over pairs of different vectors, the entropy natural; lines are null where there are none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = series.select(*keys, F.row_number().over(w).alias("i"), *(F.lead(value, d * delay).over(w).alias(f"v{d}") for d in range(dimension)))
    rows = rows.where(" and ".join(f"v{d} is not null" for d in range(dimension)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2")
    bucket = F.floor(F.col("v0") / radius)
    left = rows.withColumn("bucket", bucket)
    right = rows.select(*keys, F.col("i").alias("j"), *(F.col(f"v{d}").alias(f"u{d}") for d in range(dimension)), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = [F.abs(F.col(f"v{d}") - F.col(f"u{d}")) <= radius for d in range(dimension)]
    pairs = left.join(right, [*keys, "bucket"]).where("i < j")
    for c in near:
        pairs = pairs.where(c)
    apart = Window.partitionBy(*keys, "apart").orderBy("i")
    runs = pairs.select(*keys, "i", (F.col("j") - F.col("i")).alias("apart")).withColumn("run", F.col("i") - F.row_number().over(apart))
    lines = runs.groupBy(*keys, "apart", "run").agg(F.count("*").alias("length")).groupBy(*keys, "length").agg(F.count("*").alias("lines"))
    long = F.col("length") >= least
    shares = lines.groupBy(*keys).agg(
        F.sum(F.col("length") * F.col("lines")).alias("points"), F.sum(F.when(long, F.col("length") * F.col("lines"))).alias("on_lines"), F.sum(F.when(long, F.col("lines"))).alias("lines"),
        F.max(F.when(long, F.col("length"))).alias("longest_line"), F.sum(F.when(long, F.col("lines") * F.ln("lines"))).alias("l"),
    )
    out = counts.join(shares, keys, "left")
    total = F.col("n") * (F.col("n") - 1) / 2
    entropy = F.ln("lines") - F.col("l") / F.col("lines")
    return out.select(
        *keys, "n", (F.coalesce("points", F.lit(0)) / total).alias("recurrence_rate"), F.try_divide(F.coalesce("on_lines", F.lit(0)), "points").alias("determinism"),
        F.try_divide("on_lines", "lines").alias("mean_line"), "longest_line", entropy.alias("line_entropy"),
    )


def breath_features(df: DataFrame, keys: list[str], srate: float, order: str = "i", value: str = "x") -> DataFrame:
    """(keys, 13 features): rate, durations in seconds, amplitudes and areas of inspiration and expiration, their ratios.

    Each mean is that of the percentiles 30 to 69 over the breaths. Areas lie above the trough that bounds the half breath,
    by the trapezoid rule; they come from running sums of the signal, so no breath is joined with its samples."""
    from signalspark.operators.series import local_extrema

    w = by_order(keys, order)
    both = (F.col(value) + F.lag(value).over(w)) / 2
    area = F.sum(F.coalesce(both, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = local_extrema(df, keys, order, value).join(df.select(*keys, order, area.alias("area")), [*keys, order])
    nexts = [F.lead(c, s).over(w).alias(f"{c}{s}") for c in (order, value, "area") for s in (1, 2)]
    c = e.select(*keys, "kind", order, value, "area", F.lead("kind").over(w).alias("kind1"), *nexts)
    whole = F.expr(f"kind = 'trough' and kind1 = 'peak' and {order}2 is not null")
    col = lambda base, s: F.col(base if s == 0 else f"{base}{s}")
    ins, exp = (col(order, 1) - col(order, 0)) / srate, (col(order, 2) - col(order, 1)) / srate
    up, down = col(value, 1) - col(value, 0), col(value, 1) - col(value, 2)
    area_in = col("area", 1) - col("area", 0) - col(value, 0) * (col(order, 1) - col(order, 0))
    area_ex = col("area", 2) - col("area", 1) - col(value, 2) * (col(order, 2) - col(order, 1))
    parts = {"cycle_duration": ins + exp, "in_duration": ins, "ex_duration": exp, "in_amplitude": up, "ex_amplitude": down, "in_area": area_in, "ex_area": area_ex}
    parts |= {"duration_ratio": F.try_divide(ins, exp), "amplitude_ratio": F.try_divide(up, down), "area_ratio": F.try_divide(area_in, area_ex)}
    marks = [k / 100 for k in range(30, 70)]
    got = c.select(*keys, "kind", *(F.when(whole, v.cast("double")).alias(k) for k, v in parts.items()))
    got = got.groupBy(*keys).agg(F.greatest(F.count_if(F.col("kind") == "peak"), F.count_if(F.col("kind") == "trough")).alias("cycles"), *(F.percentile(k, F.array(*map(F.lit, marks))).alias(k) for k in parts))
    rate = F.transform("cycle_duration", lambda v: 60 / v)
    m = let(mean(rate), lambda v: F.sqrt(mean(F.transform(rate, lambda r: (r - v) * (r - v)))))
    return got.select(*keys, mean(rate).alias("rate_mean"), m.alias("rate_sd"), *(mean(F.col(k)).alias(k) for k in parts), "cycles")


def breath_cycles(df: DataFrame, keys: list[str], order: str = "i", value: str = "x") -> DataFrame:
    """(keys, trough, peak, next_trough, rise, inspiration, expiration): alternating extrema as breaths."""
    from signalspark.operators.series import local_extrema

    e = local_extrema(df, keys, order, value)
    w = by_order(keys, order)
    e = e.withColumn("peak", F.lead(order).over(w)).withColumn("top", F.lead(value).over(w)).withColumn("next_trough", F.lead(order, 2).over(w)).withColumn("next_kind", F.lead("kind").over(w))
    c = e.where("kind = 'trough' and next_kind = 'peak' and next_trough is not null")
    return c.select(
        *keys,
        F.col(order).alias("trough"),
        "peak",
        "next_trough",
        (F.col("top") - F.col(value)).alias("rise"),
        (F.col("peak") - F.col(order)).alias("inspiration"),
        (F.col("next_trough") - F.col("peak")).alias("expiration"),
    )


def lag_design(left: DataFrame, series: DataFrame, keys: list[str], lags: list[float], t: str = "t", value: str = "x") -> DataFrame:
    """Left rows with, for each lag L, the series' last value at or before t - L, as columns lag0, lag1, ..."""
    from signalspark.operators.joins import asof_join

    out = left
    for k, lag in enumerate(lags):
        shifted = series.select(*keys, (F.col(t) + F.lit(float(lag))).alias(t), F.col(value).alias(f"lag{k}"))
        out = asof_join(out, shifted, t, keys, [f"lag{k}"])
    return out


def polarity(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """(keys, sign): -1 if the 15th percentile lies farther from 0 than the 85th, else 1."""
    p = df.groupBy(*keys).agg(F.abs(F.percentile(value, 0.85)).alias("high"), F.abs(F.percentile(value, 0.15)).alias("low"))
    return p.select(*keys, F.when(F.col("low") > F.col("high"), -1).otherwise(1).alias("sign"))


def running_rate(beats: DataFrame, keys: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """(keys, start, beats): beats in tumbling windows."""
    return beats.groupBy(*keys, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("beats")).select(*keys, F.col("w.start").alias("start"), "beats")


__all__ = [
    "breath_cycles",
    "breath_features",
    "hrv_time",
    "lag_design",
    "poincare",
    "polarity",
    "quadrant_summary",
    "quadrants",
    "running_rate",
    "sliding_poincare",
]
