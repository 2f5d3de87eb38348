"""Spectral expressions: periodogram, band power, edges, aperiodic fits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalspark.functions.arrays import center, indices, interpolate, let, linear_fit, trapezoid


def hamming(n: int) -> list[float]:
    """Periodic Hamming window."""
    return [0.54 - 0.46 * math.cos(2 * math.pi * k / n) for k in range(n)]


def periodogram(x: Column, n: int, srate: float) -> Column:
    """One-sided density of an epoch of n samples: mean removed, Hamming window, bins 0 .. n/2.

    A direct transform as an array expression, for short epochs; ``kernels.welch`` takes long ones."""
    w = hamming(n)
    scale = 1.0 / (srate * sum(v * v for v in w))
    cosines = F.array(*(F.lit(math.cos(2 * math.pi * k / n)) for k in range(n)))
    sines = F.array(*(F.lit(math.sin(2 * math.pi * k / n)) for k in range(n)))
    windowed = F.zip_with(center(x), F.array(*map(F.lit, w)), lambda a, b: a * b)

    def power(s: Column, c: Column, d: Column) -> Column:
        def bin_(k: Column) -> Column:
            at = lambda i: (k * i) % n + 1
            zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
            z = F.aggregate(
                F.transform(s, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
                zero,
                lambda a, p: F.struct((a["re"] + p["v"] * F.element_at(c, at(p["i"]))).alias("re"), (a["im"] + p["v"] * F.element_at(d, at(p["i"]))).alias("im")),
            )
            twice = F.when((k == 0) | (F.lit(n % 2 == 0) & (k == n // 2)), 1.0).otherwise(2.0)
            return let(z, lambda v: (v["re"] * v["re"] + v["im"] * v["im"]) * twice * scale)

        return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), bin_)

    return let(windowed, lambda s: let(cosines, lambda c: let(sines, lambda d: power(s, c, d))))


def crop(p: Column, step: float, low: float, high: float) -> Column:
    """Bins whose frequency k * step lies in [low, high]."""
    first, last = math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9)
    return F.slice(p, first + 1, F.greatest(F.lit(0), F.least(F.lit(last), F.size(p) - 1) - first + 1))


def band_power(p: Column, step: float, low: float, high: float) -> Column:
    """Trapezoid integral over a band."""
    return trapezoid(crop(p, step, low, high), step)


def spectral_edge(p: Column, fraction: float = 0.5) -> Column:
    """Index of the first bin at which the running sum reaches a fraction of the whole; null for no bins."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("k"))
    whole = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    found = let(
        whole * fraction,
        lambda goal: F.aggregate(
            p,
            zero,
            lambda a, v: F.struct(
                (a["sum"] + v).alias("sum"), F.when((a["at"] < 0) & (a["sum"] + v >= goal), a["k"]).otherwise(a["at"]).alias("at"), (a["k"] + 1).alias("k")
            ),
        ),
    )
    return F.nullif(found["at"], F.lit(-1))


def log_fit(p: Column, step: float, low: float, high: float) -> Column:
    """struct(slope, intercept, r2) of ln p on ln f in [low, high], low > 0."""
    first = math.ceil(low / step - 1e-9)
    y = F.transform(crop(p, step, low, high), lambda v: F.ln(F.greatest(v, F.lit(1e-20))))
    x = F.transform(indices(y), lambda i: F.ln((i + first) * step))
    return linear_fit(x, y)


def trimmed_log_fit(p: Column, step: float, low: float, high: float, rounds: int = 2, quantile: float = 0.7) -> Column:
    """struct(slope, intercept, r2) of log10 p on log10 f that drops peaks: in each round the bins with residuals
    at or above the quantile go, unless fewer than five are left."""
    first = math.ceil(low / step - 1e-9)
    y = F.transform(crop(p, step, low, high), lambda v: F.when(v <= 1e-20, F.lit(-20.0)).otherwise(F.log10(v)))
    points = let(y, lambda v: F.transform(v, lambda q, i: F.struct(F.log10((i + first) * F.lit(step)).alias("f"), q.alias("p"))))

    def fit(pts: Column) -> Column:
        return linear_fit(pts["f"], pts["p"])

    def again(pts: Column) -> Column:
        def keep(f: Column) -> Column:
            residual = lambda q: q["p"] - f["slope"] * q["f"] - f["intercept"]
            ordered = F.array_sort(F.transform(pts, residual))
            return let(F.element_at(ordered, F.floor(F.size(pts) * F.lit(quantile)).cast("int") + 1), lambda t: F.filter(pts, lambda q: residual(q) < t))

        return let(let(fit(pts), keep), lambda kept: F.when(F.size(kept) >= 5, kept).otherwise(pts))

    out = points
    for _ in range(rounds):
        out = let(out, again)
    return let(out, fit)


def irasa_lite(p: Column, hset: list[float]) -> Column:
    """Aperiodic part of a spectrum: upper median over h of the geometric means of the spectrum read at f/h and f h."""
    h = F.array(*map(F.lit, hset))

    def bin_(_: Column, k: Column) -> Column:
        means = F.transform(h, lambda v: F.sqrt(interpolate(k / v, p) * interpolate(k * v, p)))
        return F.element_at(F.array_sort(means), len(hset) // 2 + 1)

    return F.transform(p, bin_)
