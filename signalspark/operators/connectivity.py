"""Connectivity between channels as edge lists.

Signals are joined on their time (an equi-join), so the work grows with channels squared per epoch and never
with channels squared times epochs squared. Edge lists (epoch keys, a, b, w) have a < b.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.stats import normal_quantile


def pairs(samples: DataFrame, keys: list[str], chan: str, t: str, columns: list[str]) -> DataFrame:
    """(keys, a, b, t, <column>_a, <column>_b): samples of each two channels at the same time."""
    left = samples.select(*keys, t, F.col(chan).alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = samples.select(*keys, t, F.col(chan).alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return left.join(right, [*keys, t]).where("a < b")


def correlation(samples: DataFrame, keys: list[str], chan: str, t: str, value: str = "x") -> DataFrame:
    """(keys, a, b, n, r); r null for a constant channel."""
    p = pairs(samples, keys, chan, t, [value]).groupBy(*keys, "a", "b")
    return p.agg(F.count("*").alias("n"), F.corr(f"{value}_a", f"{value}_b").alias("r"))


def covariance(samples: DataFrame, keys: list[str], chan: str, t: str, value: str = "x") -> DataFrame:
    """(keys, a, b, cov) with a <= b, sample covariance."""
    left = samples.select(*keys, t, F.col(chan).alias("a"), F.col(value).alias("va"))
    right = samples.select(*keys, t, F.col(chan).alias("b"), F.col(value).alias("vb"))
    return left.join(right, [*keys, t]).where("a <= b").groupBy(*keys, "a", "b").agg(F.covar_samp("va", "vb").alias("cov"))


def gaussian_mi(samples: DataFrame, keys: list[str], chan: str, t: str, value: str = "x") -> DataFrame:
    """(keys, a, b, mi): mutual information in bits of the ranks, as of Gaussian variables.

    Ranks are percent ranks within key and channel, so the measure does not depend on the values' scale."""
    ranked = samples.withColumn("rank of", F.percent_rank().over(Window.partitionBy(*keys, chan).orderBy(value)))
    r = correlation(ranked, keys, chan, t, "rank of")
    return r.select(*keys, "a", "b", F.when(1 - F.col("r") * F.col("r") > 1e-12, -0.5 * F.log2(1 - F.col("r") * F.col("r"))).alias("mi"))


def copula_mi(samples: DataFrame, keys: list[str], chan: str, t: str, value: str = "x") -> DataFrame:
    """(keys, a, b, n, mi): mutual information in bits of a Gaussian copula. Ranks within key and channel become normal
    quantiles; null where two channels agree wholly or one is constant."""
    w = Window.partitionBy(*keys, chan)
    place = (F.rank().over(w.orderBy(value)) - 0.5) / F.count(value).over(w)
    scores = samples.withColumn("score of", normal_quantile(place))
    r = correlation(scores, keys, chan, t, "score of")
    left = 1 - F.col("r") * F.col("r")
    return r.select(*keys, "a", "b", "n", F.when(left > 1e-12, -0.5 * F.log2(left)).alias("mi"))


def phase_metrics(samples: DataFrame, keys: list[str], chan: str, t: str, re: str = "re", im: str = "im") -> DataFrame:
    """(keys, a, b, coh, plv, ciplv, pli, wpli) from analytic signals (re, im) of each channel."""
    p = pairs(samples, keys, chan, t, [re, im])
    ra, ia, rb, ib = F.col(f"{re}_a"), F.col(f"{im}_a"), F.col(f"{re}_b"), F.col(f"{im}_b")
    sr, si = ra * rb + ia * ib, ia * rb - ra * ib
    size = F.sqrt(sr * sr + si * si)
    p = p.select(*keys, "a", "b", sr.alias("sr"), si.alias("si"), F.try_divide(sr, size).alias("ur"), F.try_divide(si, size).alias("ui"), (ra * ra + ia * ia).alias("pa"), (rb * rb + ib * ib).alias("pb"))
    m = p.groupBy(*keys, "a", "b").agg(
        F.avg("sr").alias("sr"), F.avg("si").alias("si"), F.avg("ur").alias("ur"), F.avg("ui").alias("ui"), F.avg("pa").alias("pa"), F.avg("pb").alias("pb"), F.avg(F.signum("si")).alias("sign"), F.avg(F.abs("si")).alias("size")
    )
    return m.select(
        *keys,
        "a",
        "b",
        F.try_divide(F.sqrt(F.col("sr") ** 2 + F.col("si") ** 2), F.sqrt(F.col("pa") * F.col("pb"))).alias("coh"),
        F.sqrt(F.col("ur") ** 2 + F.col("ui") ** 2).alias("plv"),
        F.try_divide(F.abs("ui"), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("ur") ** 2))).alias("ciplv"),
        F.abs("sign").alias("pli"),
        F.try_divide(F.abs("si"), F.col("size")).alias("wpli"),
    )


def pair_columns(edges: DataFrame, keys: list[str], names: list[tuple], prefix: str, value: str = "w") -> DataFrame:
    """Wide table with a column '<prefix>_<a>_<b>' per pair in ``names``; the pairs are given, so that the schema is
    known beforehand."""
    labels = [f"{prefix}_{a}_{b}" for a, b in names]
    label = F.concat(F.lit(f"{prefix}_"), F.col("a").cast("string"), F.lit("_"), F.col("b").cast("string"))
    return edges.withColumn("pair", label).groupBy(*keys).pivot("pair", labels).agg(F.first(value))


def block_covariance(samples: DataFrame, keys: list[str], chan: str, t: str, window: int, value: str = "x") -> DataFrame:
    """(keys, block, a, b, cov): mean products of channels in blocks of ``window`` samples, a <= b."""
    s = samples.withColumn("block", F.floor(F.col(t) / window))
    left = s.select(*keys, "block", t, F.col(chan).alias("a"), F.col(value).alias("va"))
    right = s.select(*keys, "block", t, F.col(chan).alias("b"), F.col(value).alias("vb"))
    both = left.join(right, [*keys, "block", t]).where("a <= b")
    return both.groupBy(*keys, "block", "a", "b").agg((F.sum(F.col("va") * F.col("vb")) / window).alias("cov"))


def morlet_weights(freq: float, srate: float, cycles: float) -> list[complex]:
    """Morlet wavelet of unit energy at a frequency."""
    sigma = cycles / (2 * math.pi * freq)
    half = int(math.ceil(5 * sigma * srate))
    raw = [math.exp(-((k / srate) ** 2) / (2 * sigma**2)) for k in range(-half, half + 1)]
    norm = math.sqrt(sum(v * v for v in raw))
    return [complex(v * math.cos(2 * math.pi * freq * k / srate), v * math.sin(2 * math.pi * freq * k / srate)) / norm for v, k in zip(raw, range(-half, half + 1), strict=True)]


def log_frequencies(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def band_mean(edges: DataFrame, keys: list[str], bands: DataFrame, freq: str = "f", value: str = "w") -> DataFrame:
    """Mean over the frequencies of each (inclusive, overlapping) band; ``bands`` (fmin, fmax, band) is a small list."""
    inside = edges.join(F.broadcast(bands), F.col(freq).between(F.col("fmin"), F.col("fmax")))
    return inside.groupBy(*keys, "band", "a", "b").agg(F.avg(value).alias(value))



def growing_cycles(top: float, n: int) -> list[int]:
    """Cycles of the wavelets of ``n`` frequencies: from 3 to half the top frequency, spaced by ratios, cut to whole ones."""
    return [int(v + 1e-9) for v in log_frequencies(3.0, top / 2, n)]


def _slices(batches, rows: int = 128):
    """Arrow batches of at most ``rows`` rows, as transforms and pairs need many times the room of a row."""
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


def wavelet_coefficients(epochs: DataFrame, keys: list[str], chan: str, srate: float, freqs: list[float], cycles: list[int], decim: int = 1, value: str = "x") -> DataFrame:
    """(keys, chan, re, im): coefficients of each epoch and channel, frequency after frequency, every ``decim`` th sample.

    Epochs are padded with zeros, so each frequency has as many coefficients as there are samples. Null and empty epochs are left
    out. One pass over Arrow batches; nothing is shuffled."""
    waves = [np.array(morlet_weights(f, srate, c)) for f, c in zip(freqs, cycles, strict=True)]
    rows = epochs.where(F.size(value) > 0).select(*keys, chan, F.transform(value, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("x"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keys, chan))

    def run(batches):
        for b in _slices(batches):
            x = b.column(b.num_columns - 1)
            flat, offsets = x.flatten().to_numpy(), np.append(0, np.cumsum(x.value_lengths().to_numpy()))
            re, im = [None] * len(x), [None] * len(x)
            lengths = np.diff(offsets)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                block = np.stack([flat[offsets[k] : offsets[k] + n] for k in at])
                out = []
                for w in waves:
                    size = 1 << (n + len(w) - 2).bit_length()
                    y = np.fft.ifft(np.fft.fft(block, size) * np.fft.fft(w, size))
                    half = len(w) // 2
                    out.append(y[:, half : half + n : decim])
                both = np.concatenate(out, axis=1)
                for k, row in zip(at.tolist(), both, strict=True):
                    re[k], im[k] = row.real, row.imag
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(re, pa.list_(pa.float64())), pa.array(im, pa.list_(pa.float64()))], [*b.schema.names[:-1], "re", "im"])

    return rows.mapInArrow(run, f"{kinds}, re array<double>, im array<double>")


MEASURES = ("coh", "plv", "ciplv", "pli", "wpli")


def wavelet_connectivity(
    epochs: DataFrame, keys: list[str], chan: str, srate: float, bands: DataFrame, low: float, high: float, n: int = 15, decim: int = 3, value: str = "x"
) -> DataFrame:
    """(keys, band, a, b, coh, plv, ciplv, pli, wpli): means over the frequencies of each band of the measures of each two channels.

    ``n`` frequencies from ``low`` to ``high`` spaced by ratios, wavelets of three cycles at the lowest to high / 2 at the highest.
    Coefficients meet by pair of channels, one row a pair and epoch, not by sample; channels of different lengths share the
    first samples of both. A measure that is not defined at a frequency is left out of its band's mean."""
    freqs = log_frequencies(low, high, n)
    c = wavelet_coefficients(epochs, keys, chan, srate, freqs, growing_cycles(high, n), decim, value)
    left = c.select(*keys, F.col(chan).alias("a"), F.col("re").alias("ra"), F.col("im").alias("ia"))
    right = c.select(*keys, F.col(chan).alias("b"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    both = left.join(right, keys).where("a < b").select(*keys, "a", "b", "ra", "ia", "rb", "ib")
    kinds = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in (*keys, "a", "b"))

    def measures(ra, ia, rb, ib):
        t = min(len(ra), len(rb)) // n
        za, zb = (np.asarray(r).reshape(n, -1)[:, :t] + 1j * np.asarray(i).reshape(n, -1)[:, :t] for r, i in ((ra, ia), (rb, ib)))
        s = za * zb.conj()
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.nanmean(np.where(s == 0, np.nan, s / np.abs(s)), axis=1)
            coh = np.abs(s.mean(axis=1)) / np.sqrt((np.abs(za) ** 2).mean(axis=1) * (np.abs(zb) ** 2).mean(axis=1))
            ciplv = np.abs(u.imag) / np.sqrt(np.maximum(0, 1 - u.real**2))
            pli = np.abs(np.sign(s.imag).mean(axis=1))
            wpli = np.abs(s.imag.mean(axis=1)) / np.abs(s.imag).mean(axis=1)
        return coh, np.abs(u), ciplv, pli, wpli

    def run(batches):
        for b in _slices(batches):
            found = [measures(*(np.asarray(v) for v in row)) for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns - 4, b.num_columns)), strict=True)]
            cols = [pa.array([m[k] for m in found], pa.list_(pa.float64())) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], *cols], [*b.schema.names[:-4], *MEASURES])

    rows = both.mapInArrow(run, kinds + "".join(f", {m} array<double>" for m in MEASURES))
    each = F.posexplode(F.arrays_zip(*MEASURES)).alias("k", "m")
    rows = rows.select(*keys, "a", "b", each).select(*keys, "a", "b", F.element_at(F.array(*map(F.lit, freqs)), F.col("k") + 1).alias("f"), "m.*")
    clean = rows.select(*keys, "a", "b", "f", *(F.when(~F.isnan(m), F.col(m)).alias(m) for m in MEASURES))
    inside = clean.join(F.broadcast(bands), F.col("f").between(F.col("fmin"), F.col("fmax")))
    return inside.groupBy(*keys, "band", "a", "b").agg(*(F.avg(m).alias(m) for m in MEASURES))
