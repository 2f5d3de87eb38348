"""Filters designed by windowed sinc functions and applied without delay to series of any length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _low_pass(cut: float, half: int) -> np.ndarray:
    """Taps of a low pass at ``cut`` (share of the sampling rate) with a Hamming window, of gain one at zero."""
    n = np.arange(-half, half + 1)
    taps = 2 * cut * np.sinc(2 * cut * n) * (0.54 + 0.46 * np.cos(np.pi * n / half))
    return taps / taps.sum()


def band_taps(srate: float, low: float | None, high: float | None, low_width: float | None = None, high_width: float | None = None) -> np.ndarray:
    """Taps, odd in number, of a filter that keeps [low, high] Hz; an edge of None is open.

    Transitions are a quarter of the edge wide, 2 Hz at least, and end at 0 or half the rate; the filter is 3.3 over
    the narrower one long, and is half down in their middle."""
    if low is None and high is None or low is not None and high is not None and low >= high or high is not None and high >= srate / 2 or low is not None and low <= 0:
        raise ValueError("edges must be in order, above 0 and below half the sampling rate")
    widths = []
    if low is not None:
        low_width = low_width or min(max(low / 4, 2.0), low)
        widths.append(low_width)
    if high is not None:
        high_width = high_width or min(max(high / 4, 2.0), srate / 2 - high)
        widths.append(high_width)
    half = int(np.ceil(3.3 / min(widths) * srate / 2))
    upper = _low_pass((high + high_width / 2) / srate, half) if high is not None else np.eye(1, 2 * half + 1, half)[0]
    return upper - _low_pass((low - low_width / 2) / srate, half) if low is not None else upper


def notch_taps(srate: float, freq: float, width: float | None = None, transition: float = 1.0) -> np.ndarray:
    """Taps that take out ``width`` Hz (a 200th of the frequency) about ``freq``, with transitions of ``transition`` Hz."""
    reach = (width or freq / 200) / 2 + transition / 2
    if freq - reach <= 0 or freq + reach >= srate / 2:
        raise ValueError("the notch must lie between 0 and half the sampling rate")
    half = int(np.ceil(3.3 / transition * srate / 2))
    out = _low_pass((freq - reach) / srate, half) - _low_pass((freq + reach) / srate, half)
    out[half] += 1
    return out


def fir_centred(df: DataFrame, keys: list[str], taps: np.ndarray, segment: int = 65536, order: str = "t", value: str = "x") -> DataFrame:
    """The rows' (keys, order, value) filtered without delay: output t is the sum of taps[h + k] x value at t - k, -h <= k <= h.

    ``order`` counts samples; where there is none, or a null, the filter reads 0, before the first and after the last too. A series is cut
    into segments of ``segment`` samples that bring h more on either side along, so one channel runs on many tasks and the result is that
    of one pass. Of rows with the same keys and order the last one read counts; rows stay as many as they were."""
    taps = np.asarray(taps, float)
    half = len(taps) // 2
    if len(taps) != 2 * half + 1:
        raise ValueError("taps must be odd in number")
    if half > segment:
        raise ValueError("a segment must be no shorter than half the filter")
    own = F.floor(F.col(order) / segment)
    place = F.col(order) - own * segment
    near = F.array_compact(F.array(own, F.when(place < half, own - 1), F.when(place >= segment - half, own + 1)))

    def run(key, part):
        start = int(part["segment"].iloc[0]) * segment
        at = part[order].to_numpy(np.int64) - start
        mine = (at >= 0) & (at < segment)
        if not mine.any():
            return part[[*keys, order, value]][:0]
        x = np.zeros(segment + 2 * half)
        x[at + half] = part[value].fillna(0.0).to_numpy(float)
        size = 1 << int(len(x) + 2 * half).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[2 * half : 2 * half + segment]
        out = part.loc[mine, [*keys, order]]
        return out.assign(**{value: y[at[mine]]})

    rows = df.select(*keys, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).where(F.col(order).isNotNull())
    schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + f"{order} long, {value} double"
    return rows.withColumn("segment", F.explode(near)).groupBy(*keys, "segment").applyInPandas(run, schema)
