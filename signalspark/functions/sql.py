"""The column functions as SQL functions of a session, array kernels as Arrow-batched functions, epochs as a table function.

``register(spark)`` makes them temporary, under a prefix: ``SELECT sig_hjorth(x).mobility FROM epochs``. SQL functions are expressions
that Catalyst puts in place, so they cost what the column functions cost: no Python, no shuffle. Spark does not take them inside
lambdas of the caller. ``sig_sample_entropy``, ``sig_lempel_ziv`` and ``sig_dfa`` call the kernels on Arrow batches.

``sig_epochs`` cuts ordered rows into epochs: ``SELECT * FROM sig_epochs(TABLE(SELECT chan AS key, t, x FROM samples) PARTITION BY
key ORDER BY (t), 64)``. It holds one epoch at a time, but a partition is one task: partition long channels by stretches of time too.

Null arrays give null, empty ones what the column functions give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from signalspark.functions import kernels

X, D, FIT, POINTS = "ARRAY<DOUBLE>", "DOUBLE", "STRUCT<slope: DOUBLE, intercept: DOUBLE, r2: DOUBLE>", "ARRAY<STRUCT<f: DOUBLE, p: DOUBLE>>"


def _once(value: str, name: str, body: str) -> str:
    """``body`` of a value that is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (acc, item) -> acc + item)"


_WHOLE = "(size(y) - (size(y) + 1) % 2)"  # the longest odd number of samples
_FIRST, _LAST = "int(ceil(low / step - 1e-9))", "int(floor(high / step + 1e-9))"
_RESIDUAL = "q.p - f.slope * q.f - f.intercept"
_FITTED = """named_struct('slope', try_divide(s.n * s.xy - s.x * s.y, s.n * s.xx - s.x * s.x),
    'intercept', (s.y - try_divide(s.n * s.xy - s.x * s.y, s.n * s.xx - s.x * s.x) * s.x) / s.n,
    'r2', try_divide(pow(s.n * s.xy - s.x * s.y, 2), (s.n * s.xx - s.x * s.x) * (s.n * s.yy - s.y * s.y)))"""
_CODE = """CASE WHEN x[i] <= x[i + 1] AND x[i + 1] <= x[i + 2] THEN 0 WHEN x[i] <= x[i + 1] AND x[i] <= x[i + 2] THEN 1 WHEN x[i] <= x[i + 1] THEN 2
    WHEN x[i] <= x[i + 2] THEN 3 WHEN x[i + 1] <= x[i + 2] THEN 4 ELSE 5 END"""
_BIN = """(pow(aggregate(transform(w, (v, i) -> v * cos(2 * pi() * ((k * i) % size(x)) / size(x))), 0D, (a, v) -> a + v), 2)
    + pow(aggregate(transform(w, (v, i) -> v * sin(2 * pi() * ((k * i) % size(x)) / size(x))), 0D, (a, v) -> a + v), 2))
    * IF(k = 0 OR 2 * k = size(x), 1, 2) / (srate * aggregate(transform(w, (v, i) -> pow(0.54D - 0.46D * cos(2 * pi() * i / size(x)), 2)), 0D, (a, v) -> a + v))"""
_PATH = """aggregate(transform(IF(s > 1, sequence(1, s - 1), CAST(array() AS ARRAY<INT>)), j -> abs(x[m + j * k] - x[m + (j - 1) * k])), 0D, (a, v) -> a + v)
    / k * (size(x) - 1) / (k * s)"""
_READ = "p[least(int(floor({0})), size(p) - 1)] + (p[least(int(floor({0})) + 1, size(p) - 1)] - p[least(int(floor({0})), size(p) - 1)]) * ({0} - floor({0}))"

# (name, parameters, type, body), in an order in which each uses only earlier ones.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    ("total", f"x {X}", D, _sum("x")),
    ("mean", f"x {X}", D, "sig_total(x) / size(x)"),
    ("center", f"x {X}", X, _once("sig_mean(x)", "m", "transform(x, v -> v - m)")),
    ("dot", f"x {X}, y {X}", D, _sum("zip_with(x, y, (a, b) -> a * b)")),
    ("variance", f"x {X}, ddof INT DEFAULT 0", D, _once("sig_mean(x)", "m", "aggregate(x, 0D, (a, v) -> a + (v - m) * (v - m))") + " / (size(x) - ddof)"),
    ("head", f"x {X}, drop INT", X, "slice(x, 1, greatest(0, size(x) - drop))"),
    ("tail", f"x {X}, drop INT", X, "slice(x, drop + 1, greatest(0, size(x) - drop))"),
    ("diff", f"x {X}", X, "zip_with(sig_tail(x, 1), sig_head(x, 1), (b, a) -> b - a)"),
    ("trapezoid", f"y {X}, dx {D} DEFAULT 1D", D, _sum("zip_with(sig_tail(y, 1), sig_head(y, 1), (b, a) -> (a + b) / 2)") + " * dx"),
    (
        "simpson",
        f"y {X}, dx {D} DEFAULT 1D",
        D,
        f"""CASE WHEN size(y) < 2 THEN 0D WHEN size(y) = 2 THEN (y[0] + y[1]) / 2 ELSE
        {_sum(f"transform(slice(y, 1, {_WHOLE}), (v, i) -> v * CASE WHEN i = 0 OR i = {_WHOLE} - 1 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)")} / 3
        + IF(size(y) % 2 = 0, 5D / 12 * element_at(y, -1) + 2D / 3 * element_at(y, -2) - 1D / 12 * element_at(y, -3), 0D) END * dx""",
    ),
    (
        "linear_fit",
        f"x {X}, y {X}",
        FIT,
        _once(
            """aggregate(zip_with(x, y, (a, b) -> struct(a, b)), named_struct('n', 0D, 'x', 0D, 'y', 0D, 'xx', 0D, 'xy', 0D, 'yy', 0D), (s, q) -> named_struct('n', s.n + 1,
            'x', s.x + q.a, 'y', s.y + q.b, 'xx', s.xx + q.a * q.a, 'xy', s.xy + q.a * q.b, 'yy', s.yy + q.b * q.b))""",
            "s",
            _FITTED,
        ),
    ),
    ("autocorrelation", f"x {X}, lag INT", D, "try_divide(sig_dot(sig_head(x, lag), sig_tail(x, lag)), sig_dot(x, x))"),
    ("interpolate", f"place {D}, p {X}", D, _once("least(greatest(place, 0D), size(p) - 1D)", "u", _READ.format("u"))),
    ("periodogram", f"x {X}, srate {D}", X, _once("transform(sig_center(x), (v, i) -> v * (0.54D - 0.46D * cos(2 * pi() * i / size(x))))", "w", f"transform(sequence(0, size(x) DIV 2), k -> {_BIN})")),
    ("crop", f"p {X}, step {D}, low {D}, high {D}", X, f"slice(p, {_FIRST} + 1, greatest(0, least({_LAST}, size(p) - 1) - {_FIRST} + 1))"),
    ("band_power", f"p {X}, step {D}, low {D}, high {D}", D, "sig_trapezoid(sig_crop(p, step, low, high), step)"),
    (
        "spectral_edge",
        f"p {X}, fraction {D} DEFAULT 0.5D",
        "INT",
        "nullif("
        + _once(
            "sig_total(p) * fraction",
            "goal",
            "aggregate(p, named_struct('sum', 0D, 'at', -1, 'k', 0), (a, v) -> named_struct('sum', a.sum + v, 'at', IF(a.at < 0 AND a.sum + v >= goal, a.k, a.at), 'k', a.k + 1)).at",
        )
        + ", -1)",
    ),
    (
        "log_fit",
        f"p {X}, step {D}, low {D}, high {D}",
        FIT,
        f"sig_linear_fit(transform(sig_crop(p, step, low, high), (v, i) -> ln((i + {_FIRST}) * step)), transform(sig_crop(p, step, low, high), v -> ln(greatest(v, 1e-20D))))",
    ),
    (
        "trim_points",
        f"points {POINTS}, quantile {D}",
        POINTS,
        _once(
            _once("sig_linear_fit(points.f, points.p)", "f", f"filter(points, q -> {_RESIDUAL} < array_sort(transform(points, q -> {_RESIDUAL}))[int(floor(size(points) * quantile))])"),
            "kept",
            "IF(size(kept) >= 5, kept, points)",
        ),
    ),
    (
        "log_points",
        f"p {X}, step {D}, low {D}, high {D}",
        POINTS,
        f"transform(sig_crop(p, step, low, high), (v, i) -> named_struct('f', log10((i + {_FIRST}) * step), 'p', IF(v <= 1e-20D, -20D, log10(v))))",
    ),
    ("points_fit", f"points {POINTS}", FIT, "sig_linear_fit(points.f, points.p)"),
    (
        "trimmed_log_fit",
        f"p {X}, step {D}, low {D}, high {D}, quantile {D} DEFAULT 0.7D",
        FIT,
        "sig_points_fit(sig_trim_points(sig_trim_points(sig_log_points(p, step, low, high), quantile), quantile))",
    ),
    (
        "irasa_lite",
        f"p {X}, hset {X}",
        X,
        "transform(p, (v, k) -> array_sort(transform(hset, h -> sqrt(("
        + _READ.format("least(k / h, size(p) - 1D)")
        + ") * ("
        + _READ.format("least(k * h, size(p) - 1D)")
        + "))))[size(hset) DIV 2])",
    ),
    ("ordinal_codes", f"x {X}", "ARRAY<INT>", f"IF(size(x) >= 3, transform(sequence(0, greatest(size(x) - 3, 0)), i -> {_CODE}), CAST(array() AS ARRAY<INT>))"),
    (
        "permutation_entropy",
        f"x {X}",
        D,
        "IF(size(x) >= 3, "
        + _once("sig_ordinal_codes(x)", "codes", _sum("transform(transform(sequence(0, 5), c -> size(filter(codes, v -> v = c)) / size(codes)), q -> IF(q > 0, -q * ln(q), 0D))"))
        + " / ln(6D), NULL)",
    ),
    ("pattern_complexity", f"x {X}", D, _once("size(array_distinct(sig_ordinal_codes(x)))", "c", "IF(c > 1, c * ln(c) / size(x), 0D)")),
    ("coarse", f"x {X}, scale INT", X, f"transform(sequence(0, int(floor(size(x) / scale)) - 1), g -> {_sum('slice(x, g * scale + 1, scale)')} / scale)"),
    (
        "petrosian_fd",
        f"x {X}",
        D,
        _once("size(filter(zip_with(sig_tail(sig_diff(x), 1), sig_head(sig_diff(x), 1), (b, a) -> a * b < 0), v -> v))", "c", "log10(size(x)) / (log10(size(x)) + log10(size(x) / (size(x) + 0.4D * c)))"),
    ),
    (
        "katz_fd",
        f"x {X}",
        D,
        _once(
            "named_struct('l', sig_total(transform(sig_diff(x), v -> abs(v))), 'a', sig_mean(transform(sig_diff(x), v -> abs(v))), 'd', array_max(transform(x, v -> abs(v - x[0]))))",
            "s",
            "IF(s.a = 0 OR s.d = 0, 0D, log10(s.l / s.a) / log10(s.d / s.a))",
        ),
    ),
    (
        "higuchi_fd",
        f"x {X}, kmax INT DEFAULT 10",
        D,
        "sig_linear_fit(transform(sequence(1, kmax), k -> -ln(k)), transform(sequence(1, kmax), k -> ln("
        + _sum(f"transform(sequence(0, k - 1), m -> element_at(transform(array(int(floor((size(x) - m - 1) / k))), s -> {_PATH}), 1))")
        + " / k))).slope",
    ),
    (
        "acw",
        f"x {X}, srate {D}, drop {D} DEFAULT 0.5D",
        D,
        _once(
            "sig_center(x)",
            "c",
            "coalesce(get(filter(sequence(1, size(c) - 1), lag -> try_divide("
            + _sum("zip_with(slice(c, 1, size(c) - lag), slice(c, lag + 1, size(c) - lag), (a, b) -> a * b)")
            + f", {_sum('transform(c, v -> v * v)')}) <= drop), 0), size(c)) / srate",
        ),
    ),
    (
        "hjorth",
        f"x {X}",
        "STRUCT<activity: DOUBLE, mobility: DOUBLE, complexity: DOUBLE>",
        _once(
            "named_struct('a', sig_variance(x), 'b', sig_variance(sig_diff(x)), 'c', sig_variance(sig_diff(sig_diff(x))))",
            "v",
            "named_struct('activity', v.a, 'mobility', sqrt(try_divide(v.b, v.a)), 'complexity', try_divide(sqrt(try_divide(v.c, v.b)), sqrt(try_divide(v.b, v.a))))",
        ),
    ),
]


def _by_length(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[pd.Series], pd.Series]:
    """A kernel on blocks of equal length as a function of a batch of arrays; null and empty arrays give null."""

    def run(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        sizes = np.array([0 if v is None else len(v) for v in x])
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            out[at] = kernel(np.stack([np.asarray(x.iloc[i], float) for i in at]))
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run


KERNELS = {"sample_entropy": kernels.sample_entropy, "lempel_ziv": kernels.lempel_ziv_normalised, "dfa": kernels.epoch_dfa}


class Epochs:
    """Whole epochs of ``size`` successive rows of a partition (columns key, t, x); the rest is dropped."""

    def __init__(self) -> None:
        self.number, self.start, self.held = 0, None, []

    def eval(self, row, size: int) -> Iterator[tuple]:
        if not self.held:
            self.start = float(row["t"])
        self.held.append(None if row["x"] is None else float(row["x"]))
        if len(self.held) == size:
            yield str(row["key"]) if row["key"] is not None else None, self.number, self.start, self.held
            self.number, self.held = self.number + 1, []


def register(spark: SparkSession, prefix: str = "sig_") -> list[str]:
    """Makes all functions of the session, replacing those of the same names; returns their names."""
    for name, parameters, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returns} RETURN {body.replace('sig_', prefix)}")
    for name, kernel in KERNELS.items():
        spark.udf.register(prefix + name, F.pandas_udf(_by_length(kernel), "double"))
    spark.udtf.register(f"{prefix}epochs", F.udtf(Epochs, returnType="key string, epoch bigint, start double, x array<double>"))
    return [prefix + n for n in (*(f[0] for f in FUNCTIONS), *KERNELS, "epochs")]
