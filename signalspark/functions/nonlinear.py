"""Complexity and fractal measures as array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalspark.functions.arrays import autocorrelation, center, diff, dot, head, let, linear_fit, mean, tail, total, variance


def ordinal_codes(x: Column) -> Column:
    """Pattern 0-5 of each three successive samples; the earlier sample counts as the smaller of a tie."""

    def code(i: Column) -> Column:
        a, b, c = (F.element_at(x, i + k) for k in range(3))
        ab, bc, ac = a <= b, b <= c, a <= c
        return F.when(ab & bc, 0).when(ab & ac, 1).when(ab, 2).when(ac, 3).when(bc, 4).otherwise(5)

    n = F.size(x)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), code)).otherwise(F.array().cast("array<int>"))


def permutation_entropy(x: Column) -> Column:
    """Normalised to 0-1; null below three samples."""

    def entropy(codes: Column) -> Column:
        def share(pattern: Column) -> Column:
            return F.size(F.filter(codes, lambda v: v == pattern)) / F.size(codes)

        shares = F.transform(F.sequence(F.lit(0), F.lit(5)), share)
        return total(F.transform(shares, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0))) / math.log(6)

    return F.when(F.size(x) >= 3, let(ordinal_codes(x), entropy))


def pattern_complexity(x: Column) -> Column:
    """c ln c / N for c different ordinal patterns, 0 for one."""
    return let(F.size(F.array_distinct(ordinal_codes(x))), lambda c: F.when(c > 1, c * F.ln(c) / F.size(x)).otherwise(0.0))


def coarse(x: Column, scale: int) -> Column:
    """Means of successive groups of ``scale`` samples, the rest dropped."""
    groups = F.floor(F.size(x) / scale).cast("int")
    return F.transform(F.sequence(F.lit(0), groups - 1), lambda g: mean(F.slice(x, g * scale + 1, F.lit(scale))))


def svd_entropy(x: Column) -> Column:
    """Entropy of the singular values of the embedding in three samples, over log2 3.

    Squares of the singular values are the eigenvalues of the 3 x 3 Gram matrix, in closed form."""
    a, b, c = head(x, 2), head(tail(x, 1), 1), tail(x, 2)
    gram = F.struct(*(dot(p, q).alias(k) for k, p, q in (("aa", a, a), ("bb", b, b), ("cc", c, c), ("ab", a, b), ("bc", b, c), ("ac", a, c))))

    def values(g: Column) -> Column:
        third = (g["aa"] + g["bb"] + g["cc"]) / 3
        off = g["ab"] ** 2 + g["bc"] ** 2 + g["ac"] ** 2
        spread = F.sqrt(((g["aa"] - third) ** 2 + (g["bb"] - third) ** 2 + (g["cc"] - third) ** 2 + 2 * off) / 6)
        return F.struct(*(g[k].alias(k) for k in ("aa", "bb", "cc", "ab", "bc", "ac")), third.alias("t"), spread.alias("s"))

    def singular(g: Column) -> Column:
        a, b, c = g["aa"] - g["t"], g["bb"] - g["t"], g["cc"] - g["t"]
        det = a * (b * c - g["bc"] ** 2) - g["ab"] * (g["ab"] * c - g["bc"] * g["ac"]) + g["ac"] * (g["ab"] * g["bc"] - b * g["ac"])
        r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(g["s"] == 0, 0.0).otherwise(det / (2 * g["s"] ** 3))))
        angle = F.acos(r) / 3
        return F.array(*(F.sqrt(F.greatest(F.lit(0.0), g["t"] + 2 * g["s"] * F.cos(angle + 2 * math.pi * k / 3))) for k in range(3)))

    def entropy(s: Column) -> Column:
        return let(total(s), lambda whole: total(F.transform(s, lambda v: F.when(v > 0, -(v / whole) * F.log2(v / whole)).otherwise(0.0)))) / math.log2(3)

    return let(let(let(gram, values), singular), entropy)


def petrosian_fd(x: Column) -> Column:
    n = F.size(x)
    d = diff(x)
    changes = F.size(F.filter(F.zip_with(tail(d, 1), head(d, 1), lambda b, a: a * b < 0), lambda v: v))
    return F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * changes)))


def katz_fd(x: Column) -> Column:
    """0 for a signal without change."""
    steps = F.transform(diff(x), F.abs)
    far = F.array_max(F.transform(x, lambda v: F.abs(v - F.element_at(x, 1))))
    fd = let(F.struct(total(steps).alias("l"), mean(steps).alias("a"), far.alias("d")), lambda s: F.when((s["a"] == 0) | (s["d"] == 0), 0.0).otherwise(F.log10(s["l"] / s["a"]) / F.log10(s["d"] / s["a"])))
    return fd


def higuchi_fd(x: Column, kmax: int = 10) -> Column:
    """Slope of ln L(k) on ln 1/k; the sum for (k, m) stops one step before the last that fits."""
    n = F.size(x)

    def path(k: Column, m: Column) -> Column:
        def step(j: Column) -> Column:
            return F.abs(F.element_at(x, m + j * k + 1) - F.element_at(x, m + (j - 1) * k + 1))

        def scaled(steps: Column) -> Column:
            whole = F.when(steps > 1, total(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), steps - 1)), step))).otherwise(0.0)
            return whole / k * (n - 1) / (k * steps)

        return let(F.floor((n - m - 1) / k).cast("int"), scaled)

    def length(k: Column) -> Column:
        return F.ln(total(F.transform(F.sequence(F.lit(0), k - 1), lambda m: path(k, m))) / k)

    lags = F.sequence(F.lit(1), F.lit(kmax))
    return linear_fit(F.transform(lags, lambda k: -F.ln(k)), F.transform(lags, length))["slope"]


def acw(x: Column, srate: float, drop: float = 0.5) -> Column:
    """First lag in seconds at which the autocorrelation is at most ``drop``; the whole length if it never is."""

    def first(c: Column) -> Column:
        low = F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda lag: autocorrelation(c, lag) <= drop)
        return F.coalesce(F.get(low, 0), F.size(c)) / F.lit(float(srate))

    return let(center(x), first)


def hjorth(x: Column) -> Column:
    """struct(activity, mobility, complexity)."""
    v = F.struct(variance(x).alias("v0"), variance(diff(x)).alias("v1"), variance(diff(diff(x))).alias("v2"))

    def measures(s: Column) -> Column:
        mobility = F.sqrt(F.try_divide(s["v1"], s["v0"]))
        return F.struct(s["v0"].alias("activity"), mobility.alias("mobility"), F.try_divide(F.sqrt(F.try_divide(s["v2"], s["v1"])), mobility).alias("complexity"))

    return let(v, measures)
