"""Segmentation of signals into epochs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators.joins import range_join


def sub_epochs(df: DataFrame, size: int, value: str = "x", number: str = "sub") -> DataFrame:
    """Successive parts of ``size`` samples of each array; the rest is dropped."""
    count = F.floor(F.size(value) / size).cast("int")
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1)), lambda k: F.slice(value, k * size + 1, F.lit(size))))
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.posexplode(parts).alias(number, value))


def sliding_epochs(df: DataFrame, size: int, step: int, value: str = "x", number: str = "window") -> DataFrame:
    """Windows of ``size`` samples that start every ``step`` samples; only whole ones."""
    last = F.size(value) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.posexplode(F.transform(starts, lambda s: F.slice(value, s + 1, F.lit(size)))).alias(number, value))


def event_epochs(samples: DataFrame, events: DataFrame, before: float, after: float, by: list[str] | None = None, t: str = "t", onset: str = "onset") -> DataFrame:
    """Samples within [onset - before, onset + after] of each event, with their time relative to it."""
    ranges = events.withColumn("start", F.col(onset) - before).withColumn("stop", F.col(onset) + after)
    out = range_join(samples, ranges, t, "start", "stop", before + after, by)
    return out.withColumn("relative", F.col(t) - F.col(onset)).drop("start", "stop")


def grid(df: DataFrame, keys: list[str], step: float, t: str = "t") -> DataFrame:
    """(keys, t): a regular grid from each key's first to its last time."""
    ends = df.groupBy(*keys).agg(F.floor(F.min(t) / step).alias("a"), F.floor(F.max(t) / step).alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b")).alias("step")).select(*keys, (F.col("step") * F.lit(step)).alias(t))


def fill_grid(df: DataFrame, keys: list[str], step: float, value: str, default: float, t: str = "t") -> DataFrame:
    """The grid with the mean of the values in each step, ``default`` where there are none."""
    means = df.groupBy(*keys, (F.floor(F.col(t) / step) * F.lit(step)).alias(t)).agg(F.avg(value).alias(value))
    return grid(df, keys, step, t).join(means, [*keys, t], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def sample_hold(df: DataFrame, factor: int, order: str = "i") -> DataFrame:
    """Each sample ``factor`` times."""
    rest = [c for c in df.columns if c != order]
    copies = df.withColumn("copy of", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return copies.select((F.col(order) * factor + F.col("copy of")).alias(order), *rest)


def coarse_grain(df: DataFrame, keys: list[str], scale: int, order: str = "i", value: str = "x") -> DataFrame:
    """Means of whole groups of ``scale`` successive samples."""
    out = df.groupBy(*keys, F.floor(F.col(order) / scale).alias(order)).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return out.where(F.col("n") == scale).drop("n")


def sliding_windows(df: DataFrame, size: int, step: int, order: str = "i", number: str = "window") -> DataFrame:
    """Rows with each ``window`` they stand in: window w covers places [w step, w step + size), also past the end.

    A row is listed size / step times, so windows of any length are groups of a plain aggregate."""
    last = F.floor(F.col(order) / step)
    first = F.greatest(F.lit(0), F.floor((F.col(order) - size) / step) + 1)
    return df.withColumn(number, F.explode(F.when(last >= first, F.sequence(first, last))))


def half_shift_epochs(df: DataFrame, keys: list[str], size: int, order: str = "i") -> DataFrame:
    """Rows twice, as members of two streams of whole epochs: from the first sample and from half an epoch later.

    Columns ``stream``, ``epoch``, ``u`` (place in it) and ``weight`` (raised cosine; the weights of both streams add up to 1).
    Before the second stream starts and after it ends the first has weight 1; samples past the last whole epoch of the first
    are left out."""
    ends = df.groupBy(*(F.col(k).alias(f"{k} of") for k in keys)).agg(F.count("*").alias("n"))
    df = df.join(ends, [df[k].eqNullSafe(ends[f"{k} of"]) for k in keys]).drop(*(f"{k} of" for k in keys))
    half, whole = size // 2, F.floor(F.col("n") / size) * size
    rows = df.where(F.col(order) < whole).withColumn("stream", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.col(order) - F.col("stream") * half
    inside = (F.col(order) >= half) & (F.col(order) < whole - half)
    rows = rows.where((F.col("stream") == 0) | inside)
    rows = rows.withColumn("epoch", F.floor(at / size)).withColumn("u", F.pmod(at, F.lit(size)))
    cosine = 0.5 - 0.5 * F.cos(2 * math.pi * (F.col("u") + 1) / size)
    return rows.withColumn("weight", F.when(inside, cosine).otherwise(1.0)).drop("n")


def overlap_add(rows: DataFrame, keys: list[str], order: str = "i", value: str = "x") -> DataFrame:
    """(keys, order, value): the weighted sum of both streams."""
    return rows.groupBy(*keys, order).agg(F.sum(F.col(value) * F.col("weight")).alias(value))
