"""Streaming features: sliding windows, stimulus-locked averages, filters with carried state, closed loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_stats(samples: DataFrame, keys: list[str], width: str, slide: str, late: str, ts: str = "ts", value: str = "x") -> DataFrame:
    """(keys, start, n, mean, std, rms, range) in sliding event-time windows; rows later than ``late`` are dropped.

    Aggregates only, so a window's state is a few numbers whatever its rate."""
    w = samples.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, slide).alias("w"))
    out = w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), (F.max(value) - F.min(value)).alias("range"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "mean", "std", "rms", "range")


def sliding_epochs(samples: DataFrame, keys: list[str], width: str, slide: str, late: str, ts: str = "ts", value: str = "x") -> DataFrame:
    """(keys, start, x): the ordered samples of each window, for array features; bounded by rate x width."""
    w = samples.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, slide).alias("w"))
    pairs = w.agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))).alias("s"))
    return pairs.select(*keys, F.col("w.start").alias("start"), F.col("s.v").alias("x"))


def locked_samples(samples: DataFrame, stimuli: DataFrame, by: list[str], before: str, after: str, late: str, ts: str = "ts") -> DataFrame:
    """Samples within [before, after] of stimuli, by a stream-stream interval join; both sides' state is bounded by
    the watermark and the interval."""
    s = samples.withWatermark(ts, late).alias("s")
    m = stimuli.select(*(F.col(k).alias(f"{k} of") for k in by), F.col(ts).alias("onset"), *(c for c in stimuli.columns if c not in (*by, ts))).withWatermark("onset", late).alias("m")
    on = [F.col(f"s.{k}") == F.col(f"{k} of") for k in by]
    on += [F.col(ts) >= F.col("onset") - F.expr(f"interval {before}"), F.col(ts) <= F.col("onset") + F.expr(f"interval {after}")]
    joined = s.join(m, on)
    return joined.drop(*(f"{k} of" for k in by))


def running_average(locked: DataFrame, keys: list[str], step: float, ts: str = "ts", onset: str = "onset", value: str = "x") -> DataFrame:
    """(keys, place, mean, n): the average of stimulus-locked samples so far, by steps of ``step`` seconds from the stimulus.

    Its state is one sum per key and place, however many stimuli there are; write it in update or complete mode."""
    after = F.col(ts).cast("double") - F.col(onset).cast("double")
    grouped = locked.groupBy(*keys, F.floor(after / step + 1e-6).alias("place"))
    return grouped.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def smoothed_trail(features: DataFrame, key: str, width: int, ts: str = "ts", value: str = "x") -> DataFrame:
    """(key, ts, y): each value's mean with up to ``width`` - 1 before it, carried from batch to batch.

    The state of a key is its last ``width`` - 1 values. Nulls are passed on as null and not averaged."""
    kind, stamp = features.schema[key].dataType.simpleString(), features.schema[ts].dataType.simpleString()

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
        out = []
        for x in rows[value]:
            if pd.isna(x):
                out.append(None)
                continue
            last = [*last, float(x)][-width:]
            out.append(sum(last) / len(last))
        state.update((last[-(width - 1) :] if width > 1 else [],))
        yield pd.DataFrame({key: name[0], ts: rows[ts].to_numpy(), "y": pd.Series(out, dtype=float).to_numpy()})

    return features.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} {stamp}, y double", "z array<double>", "append", GroupStateTimeout.NoTimeout)


def filtered(samples: DataFrame, key: str, coefficients: tuple[list[float], list[float]], ts: str = "ts", value: str = "x") -> DataFrame:
    """(key, ts, y): a recursive filter per channel whose state is carried from batch to batch.

    ``coefficients``: (b, a) with a[0] = 1. The state is one number per tap (direct form II transposed)."""
    b, a = ([float(v) for v in c] for c in coefficients)
    n = max(len(a), len(b))
    b, a = b + [0.0] * (n - len(b)), a + [0.0] * (n - len(a))

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z = list(state.get[0]) if state.exists else [0.0] * n
        rows = pd.concat(list(parts)).sort_values(ts)
        out = []
        for x in rows[value]:
            y = b[0] * x + z[0]
            for k in range(1, n):
                z[k - 1] = b[k] * x + z[k] - a[k] * y
            out.append(y)
        state.update((z,))
        yield pd.DataFrame({key: name[0], ts: rows[ts].to_numpy(), "y": out})

    kind = samples.schema[key].dataType.simpleString()
    stamp = samples.schema[ts].dataType.simpleString()
    return samples.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} {stamp}, y double", "z array<double>", "append", GroupStateTimeout.NoTimeout)


def closed_loop(features: DataFrame, update: Callable[[dict], None], column: str, checkpoint: str, target: float):
    """Starts a query that, per batch, hands the mean of a feature and its distance from a target to ``update``."""

    def batch(df: DataFrame, number: int) -> None:
        row = df.agg(F.avg(column).alias("mean"), F.count("*").alias("n")).first()
        if row["n"]:
            update({"batch": number, "mean": row["mean"], "error": row["mean"] - target})

    return features.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("update").start()
