"""Data behind plots, as frames: stacked waveforms, hypnograms, scalp positions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.series import with_stats


def waveform_frame(df: DataFrame, keys: list[str], chan: str, gap: float, value: str = "x", out: str = "y") -> DataFrame:
    """Values less their channel's mean, moved up by ``gap`` per channel in the order of names."""
    names = df.select(*keys, chan).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(chan))) - 1
    names = names.select(*(F.col(k).alias(f"{k} of") for k in keys), F.col(chan).alias("chan of"), place.alias("place"))
    df = with_stats(df, [*keys, chan], mean=F.avg(value))
    on = [df[k].eqNullSafe(names[f"{k} of"]) for k in keys] + [df[chan].eqNullSafe(names["chan of"])]
    moved = df.join(names, on).withColumn(out, F.col(value) - F.col("mean") + F.col("place") * gap)
    return moved.drop("mean", "place", "chan of", *(f"{k} of" for k in keys))


def hypnogram_frame(stages: DataFrame, code: str = "code", out: str = "level") -> DataFrame:
    """Stage codes as heights: wake on top, REM below it, then N1 to N3; other codes at the bottom."""
    heights = {0: 5, 4: 4, 1: 3, 2: 2, 3: 1}
    level = F.lit(0)
    for k, v in heights.items():
        level = F.when(F.col(code) == k, v).otherwise(level)
    return stages.withColumn(out, level)


def scalp_frame(positions: DataFrame) -> DataFrame:
    """(chan, u, v): the angle from the top as a radius, turned so that the nose points up."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    tilt = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("z", r)))) / (math.pi / 2)
    turn = F.atan2("y", "x")
    return positions.select("chan", (tilt * F.cos(turn)).alias("u"), (tilt * F.sin(turn)).alias("v"))
