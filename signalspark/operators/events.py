"""Event detection: slow waves, evoked peaks, state runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.marks import long_rows, marks, phases
from signalspark.operators.scans import STRETCH, by_pieces, running_sum
from signalspark.operators.series import by_order


def slow_waves(
    df: DataFrame,
    keys: list[str],
    srate: float,
    neg: tuple[float, float],
    pos: tuple[float, float],
    ptp: tuple[float, float],
    dur_neg: tuple[float, float],
    dur_pos: tuple[float, float],
    order: str = "i",
    value: str = "x",
    size: int = STRETCH,
) -> DataFrame:
    """(keys, start, neg_peak, mid, pos_peak, stop, val_neg, val_pos, ptp, duration, slope, frequency).

    A trough of depth in ``neg`` and the next peak of height in ``pos``, joined by a rising crossing; the crossing
    before the trough starts the wave and the one after the peak ends it. Durations are in seconds and exclusive,
    heights inclusive, peak-to-peak exclusive. Waves that share a start, then those that share an end, all go."""
    place, kind = df.schema[order].dataType, df.schema[value].dataType
    found = marks(df.select(*keys, order, value).dropna(subset=keys), keys, order, value, size).where("here")
    crossings = [F.col(c).cast(place).alias(c) for c in ("prev_cross", "next_cross")]
    extrema = found.select(*keys, F.col("at").cast("long").alias(order), F.col("height").cast(kind).alias(value), "kind", *crossings)
    trough = (F.col("kind") < 0) & (-F.col(value)).between(*neg)
    peak = (F.col("kind") > 0) & F.col(value).between(*pos)
    picks = extrema.withColumn("what", F.when(trough, "neg").when(peak, "pos")).where("what is not null").drop("kind")
    after = by_order(keys, order).rowsBetween(1, Window.unboundedFollowing)
    rise = F.when(F.col("what") == "pos", F.struct(F.col(order).alias("at"), F.col(value).alias("height"), F.col("prev_cross").alias("before"), F.col("next_cross").alias("after")))
    waves = picks.withColumn("pos", F.first(rise, ignorenulls=True).over(after)).where("what = 'neg' and pos is not null")
    waves = waves.select(
        *keys,
        F.col("prev_cross").alias("start"),
        F.col(order).alias("neg_peak"),
        F.col("next_cross").alias("mid"),
        F.col("pos.at").alias("pos_peak"),
        F.col("pos.after").alias("stop"),
        F.col(value).alias("val_neg"),
        F.col("pos.height").alias("val_pos"),
    )
    waves = waves.withColumn("ptp", F.abs("val_neg") + F.col("val_pos"))
    waves = waves.withColumn("duration", (F.col("stop") - F.col("start")) / srate)
    first, second = (F.col("mid") - F.col("start")) / srate, (F.col("stop") - F.col("mid")) / srate
    waves = waves.withColumn("slope", F.try_divide(-F.col("val_neg"), (F.col("mid") - F.col("neg_peak")) / srate)).withColumn("frequency", F.try_divide(F.lit(1.0), F.col("duration")))
    good = (F.col("ptp") > ptp[0]) & (F.col("ptp") < ptp[1]) & (first > dur_neg[0]) & (first < dur_neg[1]) & (second > dur_pos[0]) & (second < dur_pos[1])
    good = good & (F.col("start") < F.col("neg_peak")) & (F.col("neg_peak") < F.col("mid")) & (F.col("mid") < F.col("pos_peak")) & (F.col("pos_peak") < F.col("stop")) & (F.col("slope") > 0)
    waves = waves.where(good)
    for end in ("start", "stop"):
        waves = waves.withColumn("_times", F.count("*").over(Window.partitionBy(*keys, end))).where("_times = 1").drop("_times")
    return waves


def evoked_peaks(df: DataFrame, keys: list[str], kind: str, latency: tuple[int, int], order: str = "i", value: str = "x", size: int = STRETCH) -> DataFrame:
    """(keys, at, amplitude, start, stop, area): extrema of one kind strictly inside a range of latencies.

    A peak reaches from the crossing before to the crossing after it, or to a nearer extremum of the other
    kind; the ends of the epoch stand for missing crossings. area: sum of the values after start up to stop."""
    df = df.select(*keys, F.col(order).cast("long").alias(order), value).dropna(subset=keys)
    kind_of, inside = df.schema[value].dataType, (F.col("at") > latency[0]) & (F.col("at") < latency[1])
    columns = [*keys, *(F.col(c).cast("long").alias(c) for c in ("at", "start", "stop")), F.col("height").cast(kind_of).alias("amplitude")]

    def peaks(several_only: bool) -> DataFrame:
        found = marks(df, keys, order, value, size, several_only).where("here").where((F.col("kind") > 0) == (kind == "peak"))
        return found.where(inside & (F.col("open") == several_only)).select(*columns, "area")

    # What reaches into other stretches meets the rows there.
    parts = peaks(True).drop("area").withColumn("_piece", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("stop") / size))))
    rows = long_rows(df, keys, order, value, size).select(*keys, F.col("at").alias("_at"), F.col("height").alias("_v"), F.floor(F.col("at") / size).alias("_piece"))
    sums = parts.join(rows, [*keys, "_piece"]).where((F.col("_at") > F.col("start")) & (F.col("_at") <= F.col("stop")))
    wide = sums.groupBy(*keys, "at", "start", "stop", "amplitude").agg(F.sum("_v").alias("area"))
    return peaks(False).unionByName(wide).select(*keys, "at", "amplitude", "start", "stop", "area")


def phase(df: DataFrame, keys: list[str], order: str = "i", value: str = "x", size: int = STRETCH) -> DataFrame:
    """Piecewise-linear phase: 0 at troughs, 0.5 at peaks, 1 at the next trough; null outside the first and last."""
    return phases(df, keys, order, value, size)


def runs(df: DataFrame, keys: list[str], state: str, order: str = "i") -> DataFrame:
    """(keys, state, first, last, n): stretches of one state, by gaps and islands."""

    def changes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        return rows.withColumn("new", F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(by_order(keys, order)))).cast("int"), F.lit(1)))

    islands = running_sum(by_pieces(df, keys, order, 1, 0, changes), keys, F.col("new"), "run", order)
    return islands.groupBy(*keys, state, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")
