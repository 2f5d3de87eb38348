"""Column expressions on ``array<double>`` signals: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rnd(c: Column, digits: int = 6) -> Column:
    """Rounded, with NaN as null and no negative zero."""
    c = c.cast("double")
    return F.when(F.isnan(c), None).otherwise(F.round(c, digits) + F.lit(0.0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def center(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def variance(x: Column, ddof: int = 0) -> Column:
    return let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))) / (F.size(x) - ddof)


def head(x: Column, drop: int) -> Column:
    """All but the last ``drop`` values."""
    return F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - drop))


def tail(x: Column, drop: int) -> Column:
    """All but the first ``drop`` values."""
    return F.slice(x, drop + 1, F.greatest(F.lit(0), F.size(x) - drop))


def diff(x: Column) -> Column:
    return F.zip_with(tail(x, 1), head(x, 1), lambda b, a: b - a)


def indices(x: Column) -> Column:
    """0 .. n-1 as doubles; empty for an empty array."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: i < F.size(x)), lambda i: i.cast("double"))


def trapezoid(y: Column, dx: Column | float = 1.0) -> Column:
    return total(F.zip_with(tail(y, 1), head(y, 1), lambda b, a: (a + b) / 2)) * dx


def simpson(y: Column, dx: Column | float = 1.0) -> Column:
    """Composite Simpson rule; an even number of samples takes the last interval by the three-point correction."""
    weights = lambda n: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.when((i == 0) | (i == n - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    )
    odd = lambda v: dot(v, weights(F.size(v))) / 3.0
    last = lambda v: 5.0 / 12 * F.element_at(v, -1) + 2.0 / 3 * F.element_at(v, -2) - 1.0 / 12 * F.element_at(v, -3)
    n = F.size(y)
    return F.when(n < 2, 0.0).when(n == 2, (F.element_at(y, 1) + F.element_at(y, 2)) / 2).when(n % 2 == 1, odd(y)).otherwise(odd(head(y, 1)) + last(y)) * dx


def linear_fit(x: Column, y: Column) -> Column:
    """struct(slope, intercept, r2) of least squares; null with fewer than two values or a constant x."""
    sums = F.aggregate(
        F.arrays_zip(x.alias("a"), y.alias("b")),
        F.struct(*(F.lit(0.0).alias(k) for k in ("n", "sx", "sy", "sxx", "sxy", "syy"))),
        lambda s, p: F.struct(
            (s["n"] + 1).alias("n"),
            (s["sx"] + p["a"]).alias("sx"),
            (s["sy"] + p["b"]).alias("sy"),
            (s["sxx"] + p["a"] * p["a"]).alias("sxx"),
            (s["sxy"] + p["a"] * p["b"]).alias("sxy"),
            (s["syy"] + p["b"] * p["b"]).alias("syy"),
        ),
    )

    def fit(s):
        xx, xy, yy = s["n"] * s["sxx"] - s["sx"] * s["sx"], s["n"] * s["sxy"] - s["sx"] * s["sy"], s["n"] * s["syy"] - s["sy"] * s["sy"]
        slope = F.try_divide(xy, xx)
        return F.struct(slope.alias("slope"), ((s["sy"] - slope * s["sx"]) / s["n"]).alias("intercept"), F.try_divide(xy * xy, xx * yy).alias("r2"))

    return let(sums, fit)


def autocorrelation(x: Column, lag: Column) -> Column:
    """Of an already centred array, with the sum of squares as the unit."""
    return F.try_divide(dot(F.slice(x, F.lit(1), F.size(x) - lag), F.slice(x, lag + 1, F.size(x) - lag)), dot(x, x))


def interpolate(at: Column, y: Column) -> Column:
    """Linear interpolation of y at a place in samples, held at both ends."""
    n = F.size(y)
    low = F.least(F.greatest(F.floor(at), F.lit(0)), n - 1).cast("int")
    part = F.least(F.greatest(at - low, F.lit(0.0)), F.lit(1.0))
    a, b = F.element_at(y, low + 1), F.element_at(y, F.least(low + 2, n))
    return a + (b - a) * part
