"""Operators that use where channels are: spline weights, channels that others do not predict, channels filled in.

Positions are a driver-side table of one montage (some hundred channels), and so are all weights made of them. Samples are
shuffled once, by stretches of windows; nothing is multiplied by subsets of channels before it is in its task.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _green(cosines: np.ndarray, stiffness: int, terms: int) -> np.ndarray:
    """Sum over n of (2n + 1) / (n (n + 1))**stiffness times the Legendre polynomial of degree n, over 4 pi."""
    before, now, out = np.ones_like(cosines), cosines, np.zeros_like(cosines)
    for n in range(1, terms + 1):
        out = out + (2 * n + 1) / (n * (n + 1.0)) ** stiffness * now
        before, now = now, ((2 * n + 1) * cosines * now - n * before) / (n + 1)
    return out / (4 * np.pi)


def spline_weights(sources: np.ndarray, targets: np.ndarray, ridge: float = 1e-5, stiffness: int = 4, terms: int = 50) -> np.ndarray:
    """Weights (targets x sources) of spherical splines through values at ``sources``; each row sums to one.

    Positions are rows of three coordinates about the head's centre; only their directions count."""
    sources, targets = (p / np.linalg.norm(p, axis=1, keepdims=True) for p in (sources, targets))
    n = len(sources)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n] = _green(np.clip(sources @ sources.T, -1, 1), stiffness, terms) + ridge * np.eye(n)
    system[:n, n] = system[n, :n] = 1
    right = np.ones((len(targets), n + 1))
    right[:, :n] = _green(np.clip(targets @ sources.T, -1, 1), stiffness, terms)
    return np.linalg.solve(system, right.T).T[:, :n]


def channel_subsets(chans: list, share: float = 0.25, count: int = 50, seed: int = 0) -> list[list[int]]:
    """``count`` subsets of places in ``chans``: those of the least hashes of (seed, subset, channel). No state, so reruns agree."""
    size = max(1, int(np.ceil(share * len(chans))))
    key = lambda k, i: hashlib.md5(f"{seed}:{k}:{chans[i]}".encode()).digest()
    return [sorted(sorted(range(len(chans)), key=lambda i: key(k, i))[:size]) for k in range(count)]


def subset_weights(positions: dict, share: float = 0.25, count: int = 50, seed: int = 0) -> list[tuple[int, object, object, float]]:
    """(subset, target, chan, w): how each subset of channels predicts every channel outside it."""
    chans = sorted(positions)
    where = np.array([positions[c] for c in chans], float)
    out = []
    for k, s in enumerate(channel_subsets(chans, share, count, seed)):
        others = [i for i in range(len(chans)) if i not in s]
        if others:
            w = spline_weights(where[s], where[others])
            out += [(k, chans[i], chans[j], float(w[a, b])) for a, i in enumerate(others) for b, j in enumerate(s)]
    return out


def _dense(part: pa.Table, chan: str, t: str, value: str, chans: list) -> tuple[np.ndarray, np.ndarray]:
    """(times, channels x times with NaN where there is no sample); channels not in ``chans`` are left out."""
    code = {c: i for i, c in enumerate(chans)}
    row = np.array([code.get(c, -1) for c in part.column(chan).to_pylist()], np.int64)
    times, at = np.unique(part.column(t).to_numpy(), return_inverse=True)
    x = part.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.full((len(chans), len(times)), np.nan)
    known = row >= 0
    out[row[known], at[known]] = x[known]
    return times, out


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    norm = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / norm) if norm > 0 else float("nan")


def _blocks(df: DataFrame, keys: list[str], size: int, per_task: int, chan: str, t: str, value: str) -> DataFrame:
    """Samples with a value, by stretches of ``per_task`` windows."""
    rows = df.select(*keys, chan, F.col(t).cast("long").alias(t), F.col(value).cast("double").alias(value)).dropna(subset=[chan, t, value])
    return rows.withColumn("stretch", F.floor(F.col(t) / (size * per_task))).groupBy(*keys, "stretch")


def prediction_correlations(df: DataFrame, keys: list[str], positions: dict, size: int, share: float = 0.25, count: int = 50, seed: int = 0, chan: str = "chan", t: str = "t", value: str = "x", per_task: int = 16) -> DataFrame:
    """(keys, window, chan, r): correlation of a channel with what subsets of the others predict, per window of ``size`` samples.

    The prediction is the median over all subsets without the channel, by spherical splines. A channel takes part in a
    window if it has all times that the window has in any channel of the montage; a subset, if all its channels do. ``r``
    is null where no subset is left or something is constant. Channels without a position are left out."""
    chans = sorted(positions)
    where = np.array([positions[c] for c in chans], float)
    subsets = channel_subsets(chans, share, count, seed)
    maps = np.zeros((len(subsets), len(chans), len(chans)))
    for k, s in enumerate(subsets):
        maps[k][:, s] = spline_weights(where[s], where)
    members = np.zeros((len(subsets), len(chans)), bool)
    for k, s in enumerate(subsets):
        members[k, s] = True

    def run(key, part):
        times, x = _dense(part, chan, t, value, chans)
        out = []
        number = times // size
        for w in np.unique(number).tolist():
            y = x[:, number == w]
            y = y[:, ~np.isnan(y).all(axis=0)]
            full = ~np.isnan(y).any(axis=1) & (y.shape[1] > 0)
            usable = ~(members & ~full).any(axis=1)
            filled = np.where(full[:, None], y, 0.0)
            for i in np.flatnonzero(full):
                by = maps[usable & ~members[:, i], i]
                r = _correlation(np.median(by @ filled, axis=0), y[i]) if len(by) else float("nan")
                out.append((w, chans[i], None if np.isnan(r) else r))
        windows, names, rs = zip(*out, strict=True) if out else ((), (), ())
        heads = [pa.array([k.as_py()] * len(out), k.type) for k in key[: len(keys)]]
        return pa.table([*heads, pa.array(windows, pa.int64()), pa.array(names, part.schema.field(chan).type), pa.array(rs, pa.float64())], [*keys, "window", chan, "r"])

    heads = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return _blocks(df, keys, size, per_task, chan, t, value).applyInArrow(run, f"{heads}window long, {chan} {df.schema[chan].dataType.simpleString()}, r double")


def unpredicted_channels(df: DataFrame, keys: list[str], positions: dict, size: int, least: float = 0.75, tolerated: float = 0.4, chan: str = "chan", **options) -> DataFrame:
    """(keys, chan, windows, low, mean_r, bad): channels that the others do not predict in too many windows.

    A window is low if the correlation is below ``least`` or there is none, though the channel is there; a channel
    is bad if more than the share ``tolerated`` of its windows are low. Options are those of ``prediction_correlations``."""
    r = prediction_correlations(df, keys, positions, size, chan=chan, **options)
    votes = r.groupBy(*keys, chan).agg(F.count("*").alias("windows"), F.count_if(F.coalesce(F.col("r") < least, F.lit(True))).alias("low"), F.avg("r").alias("mean_r"))
    return votes.withColumn("bad", F.col("low") > tolerated * F.col("windows"))


def fill_channels(df: DataFrame, keys: list[str], positions: dict, segment: int, chan: str = "chan", t: str = "t", value: str = "x", only: list | None = None) -> DataFrame:
    """(keys, chan, t, x): the samples, and for channels of the montage that a segment lacks, their splines.

    Per segment of ``segment`` samples, channels with all its times predict those with none at all (of ``only``, if given).
    Channels with some of the times, and channels without a position, stay as they are. A segment without any whole channel
    gains nothing. Where (keys, chan, t) repeats, the sample comes out once."""
    chans = sorted(positions)
    where = np.array([positions[c] for c in chans], float)
    wanted = np.array([only is None or c in only for c in chans])

    def run(key, part):
        weights = lru_cache(maxsize=8)(lambda have, lack: spline_weights(where[list(have)], where[list(lack)]))
        times, x = _dense(part, chan, t, value, chans)
        number = times // segment
        cols = [[], [], []]
        for w in np.unique(number).tolist():
            at = (number == w) & ~np.isnan(x).all(axis=0)
            gap = np.isnan(x[:, at])
            have, lack = np.flatnonzero(~gap.any(axis=1)), np.flatnonzero(gap.all(axis=1) & wanted)
            if at.any() and len(have) and len(lack):
                made = weights(tuple(have), tuple(lack)) @ x[np.ix_(have, at)]
                for i, row in zip(lack.tolist(), made, strict=True):
                    for c, v in zip(cols, ([chans[i]] * at.sum(), times[at], row), strict=True):
                        c.extend(v)
        names = [chan, t, value]
        own = part.select(names).group_by([chan, t]).aggregate([(value, "min")]).rename_columns(names)
        new = pa.table([pa.array(c, own.schema.field(n).type) for c, n in zip(cols, names, strict=True)], names)
        rows = pa.concat_tables([own, new])
        for i, k in enumerate(keys):
            rows = rows.add_column(i, k, pa.array([key[i].as_py()] * rows.num_rows, key[i].type))
        return rows

    heads = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return _blocks(df, keys, segment, 1, chan, t, value).applyInArrow(run, f"{heads}{chan} {df.schema[chan].dataType.simpleString()}, {t} long, {value} double")
