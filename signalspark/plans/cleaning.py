"""Cleaning as an ordered list of named steps over samples (keys, chan, t, x)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators import cleaning, filters, series, spatial, timeline
from signalspark.operators.segment import coarse_grain


def _drop_flat(df: DataFrame, keys: list[str], least: float = 1e-15) -> DataFrame:
    flat = cleaning.flat_channels(df, [*keys, "chan"], "x", least).drop("std")
    return df.join(flat, [*keys, "chan"], "left_anti")


def _drop_outliers(df: DataFrame, keys: list[str], limit: float = 5.0) -> DataFrame:
    """Channels whose standard deviation is ``limit`` robust deviations or more from the median over channels go."""
    std = df.groupBy(*keys, "chan").agg(F.stddev_pop("x").alias("std"))
    std = series.with_stats(std, keys, centre=F.percentile("std", 0.5), spread=(F.percentile("std", 0.75) - F.percentile("std", 0.25)) / 1.35)
    bad = std.where(F.abs(F.col("std") - F.col("centre")) >= limit * F.col("spread")).where("spread > 0").select(*keys, "chan")
    return df.join(bad, [*keys, "chan"], "left_anti")


def _mask(df: DataFrame, keys: list[str], size: int, low: float = -3.5, high: float = 5.0, share: float = 0.25) -> DataFrame:
    bad = cleaning.window_mask(df, keys, "chan", size, low, high, share, "t").where("bad").select(*keys, "window")
    return df.withColumn("window", F.floor(F.col("t") / size)).join(bad, [*keys, "window"], "left_anti").drop("window")


def _interpolate(df: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """Channels that are targets of ``weights`` (target, chan, w) are replaced by weighted sums of the others."""
    made = cleaning.apply_weights(df, weights, keys, "chan", "target", "t")
    own = df.join(weights.select(F.col("target").alias("chan")).distinct(), "chan", "left_anti")
    return own.select(*keys, "chan", "t", "x").unionByName(made.select(*keys, F.col("target").alias("chan"), "t", "x"))


def _drop_unpredicted(df: DataFrame, keys: list[str], positions: dict, size: int, **options) -> DataFrame:
    bad = spatial.unpredicted_channels(df, keys, positions, size, **options).where("bad").select(*keys, "chan")
    return df.join(bad, [*keys, "chan"], "left_anti")


STEPS: dict[str, Callable[..., DataFrame]] = {
    "crop": lambda df, keys, start, stop: df.where((F.col("t") >= start) & (F.col("t") < stop)),
    "crop_centred": lambda df, keys, width: timeline.crop_centred(df, keys, width),
    "drop_channels": lambda df, keys, names: df.where(~F.col("chan").isin(list(names))),
    "drop_flat": _drop_flat,
    "drop_outliers": _drop_outliers,
    "filter": lambda df, keys, taps: cleaning.fir(df, [*keys, "chan"], list(taps), "t").drop("x").withColumnRenamed("y", "x"),
    "band": lambda df, keys, srate, low, high: filters.fir_centred(df, [*keys, "chan"], filters.band_taps(srate, low, high)),
    "notch": lambda df, keys, srate, freq: filters.fir_centred(df, [*keys, "chan"], filters.notch_taps(srate, freq)),
    "drop_unpredicted": _drop_unpredicted,
    "fill_channels": lambda df, keys, positions, segment=4096: spatial.fill_channels(df, keys, positions, segment),
    "detrend": lambda df, keys: series.detrend(df, [*keys, "chan"], "t").drop("x").withColumnRenamed("y", "x"),
    "downsample": lambda df, keys, factor: coarse_grain(df, [*keys, "chan"], factor, "t"),
    "mask_windows": _mask,
    "interpolate": _interpolate,
    "reference": lambda df, keys, full_rank=False: cleaning.average_reference(df, [*keys, "t"], "x", full_rank),
}


def clean(df: DataFrame, keys: list[str], steps: list[tuple[str, dict]]) -> DataFrame:
    """Samples after all steps, in the order given; ``t`` counts samples. Nothing runs before the result is asked for.

    An unknown step is an error before anything is planned; no steps give the samples as they came."""
    unknown = [name for name, _ in steps if name not in STEPS]
    if unknown:
        raise ValueError(f"unknown cleaning steps: {unknown}; known: {sorted(STEPS)}")
    df = df.select(*keys, "chan", "t", "x")
    for name, options in steps:
        df = STEPS[name](df, keys, **options).select(*keys, "chan", "t", "x")
    return df


def run_log(df: DataFrame, keys: list[str], steps: list[tuple[str, dict]]) -> DataFrame:
    """(keys, step, name, channels, samples, rms): what each step left, 0 for the input. Each step's row is a plan of its own,
    so the log costs as many passes as there are steps; ask for it apart from the result."""
    rows = []
    for k in range(len(steps) + 1):
        name = steps[k - 1][0] if k else "input"
        got = clean(df, keys, steps[:k]).groupBy(*keys)
        rows.append(got.agg(F.count_distinct("chan").alias("channels"), F.count("*").alias("samples"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).select(*keys, F.lit(k).alias("step"), F.lit(name).alias("name"), "channels", "samples", "rms"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
