"""Cleaning operators that need no more than neighbours and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.scans import by_pieces, running_sum
from signalspark.operators.series import by_order, with_stats


def haar_levels(df: DataFrame, keys: list[str], levels: int, order: str = "i", value: str = "x") -> DataFrame:
    """Undecimated Haar details d1 .. dn and the rest an; samples before the first repeat it."""

    def levels_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        w = by_order(keys, order)
        rows = rows.withColumn("a0", F.col(value))
        for k in range(1, levels + 1):
            before = F.coalesce(F.lag(f"a{k - 1}", 1 << (k - 1)).over(w), F.first(f"a{k - 1}").over(w))
            rows = rows.withColumn(f"a{k}", (F.col(f"a{k - 1}") + before) / 2).withColumn(f"d{k}", F.col(f"a{k - 1}") - F.col(f"a{k}"))
        return rows.drop(*(f"a{k}" for k in range(levels)))

    return by_pieces(df, keys, order, (1 << levels) - 1, 0, levels_of)


def average_reference(df: DataFrame, keys: list[str], value: str = "x", full_rank: bool = False) -> DataFrame:
    """Values less the mean over channels at each time (``keys`` name a time); ``full_rank`` divides by one more."""
    df = with_stats(df, keys, ref=F.sum(value) / (F.count(value) + (1 if full_rank else 0)))
    return df.withColumn(value, F.col(value) - F.col("ref")).drop("ref")


def flat_channels(df: DataFrame, keys: list[str], value: str = "x", least: float = 1e-15) -> DataFrame:
    """Channels whose standard deviation is below ``least``."""
    return df.groupBy(*keys).agg(F.stddev_pop(value).alias("std")).where(F.coalesce(F.col("std") < least, F.lit(True)))


def flat_runs(df: DataFrame, keys: list[str], samples: int, order: str = "i", value: str = "x") -> DataFrame:
    """(keys, first, last): runs of at least ``samples`` equal values."""

    def changes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        return rows.withColumn("new", F.coalesce((F.col(value) != F.lag(value).over(by_order(keys, order))).cast("int"), F.lit(1)))

    runs = running_sum(by_pieces(df, keys, order, 1, 0, changes), keys, F.col("new"), "run", order)
    out = runs.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= samples).drop("run")


def window_mask(df: DataFrame, time_keys: list[str], chan: str, size: int, low: float, high: float, share: float, order: str = "i", value: str = "x") -> DataFrame:
    """(time_keys, window, bad): windows of ``size`` samples that too many channels leave.

    The root mean square of each channel and window is standardised by the channel's median and interquartile
    range over windows; a window is bad if more than ``share`` of the channels lie above ``high`` or below ``low``."""
    rms = df.groupBy(*time_keys, chan, F.floor(F.col(order) / size).alias("window")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    centre, spread = F.percentile("rms", 0.5), (F.percentile("rms", 0.75) - F.percentile("rms", 0.25)) / 1.35
    z = with_stats(rms, [*time_keys, chan], centre=centre, spread=spread)
    z = z.withColumn("z", F.try_divide(F.col("rms") - F.col("centre"), F.col("spread")))
    votes = z.groupBy(*time_keys, "window").agg(F.count_if(F.col("z") > high).alias("above"), F.count_if(F.col("z") < low).alias("below"), F.count("*").alias("chans"))
    return votes.select(*time_keys, "window", (F.greatest("above", "below") > F.floor(F.col("chans") * share)).alias("bad"))


def adaptive_threshold(components: DataFrame, keys: list[str], ratio: float, loss: float, low: float, prob: str = "prob") -> DataFrame:
    """Components (keys, component, prob, chans) to remove: those of the lowest admissible threshold.

    As the threshold falls, components come in by falling probability; it stops before more than ratio x chans
    are in or before their summed 1 - prob exceeds ``loss``. Equal probabilities come in together."""
    w = Window.partitionBy(*keys).orderBy(F.desc(prob)).rangeBetween(Window.unboundedPreceding, 0)
    c = components.where(F.col(prob) >= low).withColumn("taken", F.count("*").over(w)).withColumn("lost", F.sum(1 - F.col(prob)).over(w))
    return c.where((F.col("taken") <= F.col("chans") * ratio) & (F.col("lost") <= loss)).drop("taken", "lost")


def apply_weights(samples: DataFrame, weights: DataFrame, keys: list[str], chan: str, target: str, order: str = "i", value: str = "x") -> DataFrame:
    """(keys, target, order, value): weighted sums over channels, as in component time courses or interpolation.

    ``weights``: (target, chan, w), a small table per montage."""
    rows = samples.join(weights, chan)
    return rows.groupBy(*keys, target, order).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def fir(df: DataFrame, keys: list[str], taps: list[float], order: str = "i", value: str = "x", out: str = "y") -> DataFrame:
    """Causal FIR filter with zeros before the first sample, as a sum of lags; for short filters."""

    def filtered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        w = by_order(keys, order)
        return rows.withColumn(out, sum((F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * t for k, t in enumerate(taps) if k), F.col(value) * taps[0]))

    return by_pieces(df, keys, order, len(taps) - 1, 0, filtered)
