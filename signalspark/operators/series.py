"""Operators on long series (keys, order, value).

Statistics of a whole series come from a grouped aggregate that is joined back, so a long channel is combined
on the map side; running sums and windows of neighbours go by stretches (``scans``), so it runs on many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signalspark.operators.marks import marks
from signalspark.operators.scans import STRETCH, by_pieces, running_sum

MOMENTS = ("part_n", "part_mi", "part_my", "part_ii", "part_iy", "part_yy")


def with_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Joins aggregates per key to all rows; null keys match each other."""
    s = df.groupBy(*(F.col(k).alias(f"{k} of") for k in keys)).agg(*(c.alias(n) for n, c in stats.items()))
    on = [df[k].eqNullSafe(s[f"{k} of"]) for k in keys]
    return df.join(s, on).drop(*(f"{k} of" for k in keys))


def zscore(df: DataFrame, keys: list[str], value: str = "x", out: str = "z", ddof: int = 0, eps: float = 0.0) -> DataFrame:
    std = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    df = with_stats(df, keys, mean=F.avg(value), std=std + eps)
    return df.withColumn(out, F.try_divide(F.col(value) - F.col("mean"), F.col("std"))).drop("mean", "std")


def detrend(df: DataFrame, keys: list[str], order: str = "i", value: str = "x", out: str = "y") -> DataFrame:
    df = with_stats(df, keys, slope=F.regr_slope(value, order), intercept=F.regr_intercept(value, order))
    return df.withColumn(out, F.col(value) - (F.col("intercept") + F.col("slope") * F.col(order))).drop("slope", "intercept")


def by_order(keys: list[str], order: str = "i"):
    return Window.partitionBy(*keys).orderBy(order)


def box_smooth(df: DataFrame, keys: list[str], width: int, order: str = "i", value: str = "x", out: str = "y") -> DataFrame:
    """Moving sum over ``width`` samples, zeros beyond the ends, divided by width."""
    back, ahead = width // 2, (width - 1) // 2

    def smooth(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        return rows.withColumn(out, F.sum(value).over(by_order(keys, order).rowsBetween(-back, ahead)) / width)

    return by_pieces(df, keys, order, back, ahead, smooth)


def trailing_mean(df: DataFrame, keys: list[str], width: int, order: str = "i", value: str = "x", out: str = "y") -> DataFrame:
    """Mean over the last ``width`` samples, with zeros before the first."""

    def smooth(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        return rows.withColumn(out, F.sum(value).over(by_order(keys, order).rowsBetween(1 - width, 0)) / width)

    return by_pieces(df, keys, order, width - 1, 0, smooth)


def walk(df: DataFrame, keys: list[str], order: str = "i", value: str = "x", out: str = "y") -> DataFrame:
    """Running sum of what is left after the mean."""
    df = with_stats(df, keys, mean=F.avg(value), n=F.count(value))
    return running_sum(df, keys, F.col(value) - F.col("mean"), out, order).drop("mean")


def zero_crossings(df: DataFrame, keys: list[str], order: str = "i", value: str = "x") -> DataFrame:
    """Rows after which the sign (above zero or not) changes."""
    df = by_pieces(df, keys, order, 0, 1, lambda rows, keys, order: rows.withColumn("after", F.lead(value).over(by_order(keys, order))))
    return df.where(F.col("after").isNotNull() & ((F.col(value) > 0) != (F.col("after") > 0))).drop("after")


def local_extrema(df: DataFrame, keys: list[str], order: str = "i", value: str = "x", low: float | None = None, high: float | None = None, size: int = STRETCH) -> DataFrame:
    """Local extrema with kind 'peak' or 'trough'; a plateau counts once, at its middle (rounded down).

    ``low`` and ``high`` bound the height: the value of a peak, minus the value of a trough. A run of equal values is an
    extremum if both neighbours lie on the same side of it."""
    out = marks(df, keys, order, value, size).withColumn("_height", F.when(F.col("kind") > 0, F.col("height")).otherwise(-F.col("height")))
    if low is not None:
        out = out.where(F.col("_height") >= low)
    if high is not None:
        out = out.where(F.col("_height") <= high)
    kind = F.when(F.col("kind") > 0, "peak").otherwise("trough")
    return out.select(*keys, F.col("at").cast("long").alias(order), F.col("height").cast(df.schema[value].dataType).alias(value), kind.alias("kind"))


def binarise(df: DataFrame, keys: list[str], value: str = "x", out: str = "bit") -> DataFrame:
    df = with_stats(df, keys, mean=F.avg(value))
    return df.withColumn(out, (F.col(value) > F.col("mean")).cast("int")).drop("mean")


def trimmed_mean(df: DataFrame, keys: list[str], share: float = 0.1, value: str = "x", out: str = "trimmed") -> DataFrame:
    """Mean without the smallest and largest ``share`` of the values (floor of share x n at each end)."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(value).over(w))
    cut = F.floor(F.col("n") * share)
    return ranked.where((F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut)).groupBy(*keys).agg(F.avg(value).alias(out))


def robust_sigma(value: str = "x") -> Column:
    """Interquartile range over 1.35."""
    return (F.percentile(value, 0.75) - F.percentile(value, 0.25)) / 1.35


def percentile_mean(value: str = "x", low: int = 30, high: int = 69) -> Column:
    """Mean of the percentiles low .. high."""
    p = F.percentile(value, F.array(*(F.lit(k / 100) for k in range(low, high + 1))))
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / (high - low + 1)


def log_scales(n: Column, least: int, factor: float) -> Column:
    """Distinct scales floor(least factor**k) up to a tenth of n; empty for short series."""
    top = F.floor(F.ln(n * 0.1 / least) / F.ln(F.lit(factor)))
    powers = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), top).cast("int")), lambda k: F.floor(least * F.pow(F.lit(factor), k)))
    return F.when(top >= 0, F.array_distinct(powers)).otherwise(F.array().cast("array<bigint>"))


def _moments(i: np.ndarray, y: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, n, mean of i, mean of y, and the sums of squares and products about them) of runs of equal blocks."""
    starts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
    n = np.diff(np.append(starts, len(block)))
    mi, my = np.add.reduceat(i, starts) / n, np.add.reduceat(y, starts) / n
    di, dy = i - np.repeat(mi, n), y - np.repeat(my, n)
    return block[starts], n.astype(float), mi, my, *(np.add.reduceat(v, starts) for v in (di * di, di * dy, dy * dy))


def _merge(a: Column, b: Column) -> Column:
    """Moments of two parts of a block."""
    n, di, dy = a["n"] + b["n"], b["mi"] - a["mi"], b["my"] - a["my"]
    w = a["n"] * b["n"] / n
    parts = {"n": n, "mi": a["mi"] + di * b["n"] / n, "my": a["my"] + dy * b["n"] / n}
    parts |= {"ii": a["ii"] + b["ii"] + w * di * di, "iy": a["iy"] + b["iy"] + w * di * dy, "yy": a["yy"] + b["yy"] + w * dy * dy}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def block_errors(df: DataFrame, keys: list[str], least: int, factor: float, order: str = "i", value: str = "x", size: int = STRETCH) -> DataFrame:
    """(keys, n, scale, error): mean squared error about the line of each block of the walk, per scale.

    Series come to the kernel by stretches of ``size`` of their order, with the walk up to there from the stretches' sums. A block
    inside a stretch is settled there, so a task keeps no row a block; of a block over several, moments are merged."""
    rows = df.select(*keys, F.col(order).cast("double").alias("i"), F.col(value).cast("double").alias("v"), F.floor(F.col(order) / size).cast("long").alias("piece"))
    group, every = [*keys, "piece"], Window.partitionBy(*keys)
    sums = rows.groupBy(*group).agg(F.sum("v").alias("s"), F.count("v").alias("c")).withColumn("n", F.sum("c").over(every))
    sums = sums.withColumn("mean", F.try_divide(F.sum("s").over(every), F.col("n")))
    before = every.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("carry", F.sum(F.coalesce("s", F.lit(0.0)) - F.col("mean") * F.col("c")).over(before)).withColumn("seen", F.coalesce(F.sum("c").over(before), F.lit(0)))
    sums = sums.select(*(F.col(k).alias(f"its {k}") for k in group), "n", "mean", F.coalesce("carry", F.lit(0.0)).alias("carry"), "seen", log_scales(F.col("n"), least, factor).alias("scales"))
    kinds = [df.schema[k] for k in keys]
    found = {"n": "long", "scale": "long", "errors": "array<double>", "block": "long", **dict.fromkeys(MOMENTS, "double")}
    out = T.StructType([*kinds, *(T.StructField(k, T._parse_datatype_string(t)) for k, t in found.items())])
    arrow = to_arrow_schema(out)

    def kernel(key, part: pa.Table, its: pa.Table, inside: bool) -> pa.Table:
        rows, known = [], its.to_pylist()[0] if its.num_rows else {"scales": None}
        i, v = (part.column(c).to_numpy() for c in ("i", "v"))
        if known["scales"] and len(i):
            v = np.where(part.column("v").is_valid().to_numpy(), v, np.nan) if part.column("v").null_count else v
            at = np.argsort(i, kind="stable")
            i, there = i[at], ~part.column("v").is_null().to_numpy()[at]
            y = known["carry"] + np.cumsum(np.where(there, v[at] - known["mean"], 0.0))
            ok = (np.cumsum(there) + known["seen"]) > 0
            i, y = i[ok], y[ok]
            first, stop = int(key[-1].as_py()) * size, (int(key[-1].as_py()) + 1) * size
            for scale in known["scales"]:
                block = np.floor(i / scale).astype(np.int64)
                use = (block < known["n"] // scale) & (((block * scale >= first) & ((block + 1) * scale <= stop)) == inside)
                if not use.any():
                    continue
                own, *m = _moments(i[use], y[use], block[use])
                if inside:
                    _, _, _, ii, iy, yy = m
                    error = np.maximum(yy - np.divide(iy * iy, ii, out=yy.copy(), where=ii > 0), 0) / scale
                    rows.append({"n": known["n"], "scale": scale, "errors": error})
                else:
                    rows += [{"n": known["n"], "scale": scale, "block": int(b), **dict(zip(MOMENTS, map(float, x), strict=True))} for b, *x in zip(own, *m, strict=True)]
        names = {k.name: v.as_py() for k, v in zip(kinds, key, strict=False)}
        return pa.Table.from_pylist([names | r for r in rows], arrow)

    pairs = rows.groupBy(*group).cogroup(sums.groupBy(*(f"its {k}" for k in group)))
    whole = pairs.applyInArrow(lambda key, part, its: kernel(key, part, its, True), out)
    cut = pairs.applyInArrow(lambda key, part, its: kernel(key, part, its, False), out)
    parts = cut.groupBy(*keys, "n", "scale", "block").agg(F.collect_list(F.struct(*(F.col(c).alias(k) for c, k in zip(MOMENTS, ("n", "mi", "my", "ii", "iy", "yy"), strict=True)))).alias("m"))
    all_of = F.aggregate(F.slice("m", F.lit(2), F.size("m")), F.col("m")[0], _merge)
    parts = parts.withColumn("m", all_of)
    sse = F.col("m.yy") - F.coalesce(F.try_divide(F.pow("m.iy", F.lit(2)), F.col("m.ii")), F.col("m.yy"))
    return whole.select(*keys, "n", "scale", F.explode("errors").alias("error")).unionByName(parts.select(*keys, "n", "scale", (F.greatest(sse, F.lit(0.0)) / F.col("scale")).alias("error")))


def dfa(df: DataFrame, keys: list[str], order: str = "i", value: str = "x") -> DataFrame:
    """(keys, alpha): detrended fluctuation analysis over scales 4 1.2**k; null with fewer than two scales."""
    f = block_errors(df, keys, 4, 1.2, order, value).groupBy(*keys, "scale").agg(F.sqrt(F.avg("error")).alias("f")).where("f > 0")
    return f.groupBy(*keys).agg(F.regr_slope(F.ln("f"), F.ln("scale")).alias("alpha"))


def mfdfa(df: DataFrame, keys: list[str], orders: list[float], order: str = "i", value: str = "x") -> DataFrame:
    """(keys, q, h): generalised Hurst exponents over scales 10 1.25**k."""
    e = block_errors(df, keys, 10, 1.25, order, value)
    powers = [F.avg(F.when(F.col("error") > 0, F.pow("error", F.lit(q / 2)))) for q in orders]
    still = F.avg(F.when(F.col("error") > 1e-20, F.ln("error")))
    # One group a scale for all orders, which become rows afterwards.
    f = e.groupBy(*keys, "scale").agg(F.array(*(F.struct(F.lit(q).alias("q"), p.alias("power")) for q, p in zip(orders, powers, strict=True))).alias("all"), still.alias("still"))
    f = f.select(*keys, "scale", "still", F.inline("all"))
    f = f.withColumn("f", F.when(F.abs("q") < 1e-9, F.exp(F.col("still") / 2)).otherwise(F.pow("power", F.try_divide(F.lit(1.0), F.col("q"))))).where("f > 0")
    return f.groupBy(*keys, "q").agg(F.regr_slope(F.log10("f"), F.log10("scale")).alias("h"))


def mf_spectrum(h: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h2, width, alpha0) of (keys, q, h): gradient of h over q, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy("q")
    prev, nxt = (F.lag, F.lead)
    dh = F.coalesce(nxt("h").over(w), F.col("h")) - F.coalesce(prev("h").over(w), F.col("h"))
    dq = F.coalesce(nxt("q").over(w), F.col("q")) - F.coalesce(prev("q").over(w), F.col("q"))
    a = h.withColumn("alpha", F.col("h") + F.col("q") * F.try_divide(dh, dq))
    return a.groupBy(*keys).agg(
        F.max(F.when(F.abs(F.col("q") - 2) < 1e-9, F.col("h"))).alias("h2"),
        (F.max("alpha") - F.min("alpha")).alias("width"),
        F.max(F.when(F.abs("q") < 1e-9, F.col("alpha"))).alias("alpha0"),
    )
