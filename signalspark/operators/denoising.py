"""Denoising against a reference covariance, with a search for the limit.

A recording is cut into two streams of epochs, the second half an epoch later, and put together by raised cosines. In an epoch
the generalised components of its covariance and the reference whose power over the reference reaches a limit are taken out.

Which components go depends on how many lie above the limit, so for an epoch of n channels there are n + 1 outcomes. Their
scores are computed once an epoch and stored as arrays; every threshold is then a lookup and a mean over epochs, and a whole
grid of thresholds is one aggregate with partial sums. Samples are read for the covariances and once more to be cleaned.

Odd rows: samples whose key, time or value is null (or NaN), and channels that the reference lacks, come back as they are.
Repeated samples of a channel and time count as their mean and come back once. A channel without a sample at a time counts as
0 there and gets none. The last epoch takes what is left over after whole ones; a recording shorter than an epoch is one.
Tables without rows give tables without rows; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signalspark.operators.cleaning import average_reference, haar_levels
from signalspark.operators.lineage import cut

TOP = 3  # directions compared with the reference
SHARE = 0.95  # of the components' powers that count as usual
SLICE = 64  # epochs whose samples are handed on at once
SHIFT = 100.0  # added to logarithms of powers, so that thresholds are shares of positive numbers


# --- one epoch -------------------------------------------------------------------------------------------------
def regularised(reference: np.ndarray, mix: float = 0.05) -> np.ndarray:
    """The reference with a share of its mean eigenvalue on the diagonal, so that it can be inverted."""
    return (1 - mix) * reference + mix * np.linalg.eigvalsh(reference).mean() * np.eye(len(reference))


def generalised(cov: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(powers, filters, patterns) of cov v = p ref v, strongest first; patterns @ filters.T is the identity."""
    low = np.linalg.cholesky(ref)
    inv = np.linalg.inv(low)
    p, v = np.linalg.eigh(inv @ cov @ inv.T)
    p, v = p[::-1], v[:, ::-1]
    return p, inv.T @ v, low @ v


def likeness(cov: np.ndarray, template: np.ndarray, whole: bool = True) -> float:
    """Product of the cosines of the principal angles between the strongest directions of ``cov`` and the template's.

    Where ``cov`` has fewer directions than the template, missing ones count as orthogonal, so the likeness is 0. If not ``whole``
    only those there are count, and no direction at all gives 0."""
    return likenesses(cov[None], template, whole)[0]


def likenesses(covs: np.ndarray, template: np.ndarray, whole: bool = True) -> list[float]:
    """``likeness`` of each of many covariances."""
    p, v = np.linalg.eigh((covs + covs.transpose(0, 2, 1)) / 2)
    k = template.shape[1]
    there = np.minimum(k, (p > 1e-12 * np.maximum(p[:, -1:], 1e-300)).sum(axis=1))
    out = np.zeros(len(covs))
    for h in [k] if whole else range(1, k + 1):
        at = np.flatnonzero(there == h)
        if len(at):
            out[at] = np.prod(np.linalg.svd(v[at][:, :, -h:].transpose(0, 2, 1) @ template, compute_uv=False), axis=1)
    return out.tolist()


def outcomes(cov: np.ndarray, faded: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, list[float], list[float]]:
    """(powers, likeness of what stays, likeness of what goes) with 0, 1, ... n of the strongest components taken out.

    ``faded`` is the covariance of the epoch under its weights, by which what stays is judged. What stays must hold all of the
    template's directions; what goes is judged by those it has, so that taking out one or two components has its price."""
    powers, filters, patterns = generalised(cov, ref)
    n = len(ref)
    template = np.linalg.eigh(ref)[1][:, -min(TOP, n) :]
    out = np.stack([patterns[:, :k] @ filters[:, :k].T for k in range(n + 1)])
    left, out = (np.eye(n) - out)[:n], out[1:]
    stay = likenesses(left @ faded @ left.transpose(0, 2, 1), template)
    return powers, [*stay, 0.0], [0.0, *likenesses(out @ cov @ out.transpose(0, 2, 1), template, False)]


def _cov(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    return x @ x.T / max(1, x.shape[1] - 1)


# --- tables ----------------------------------------------------------------------------------------------------
def _attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of ``small`` by keys, of which nulls are equal to nulls."""
    named = small.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    return df.join(named, [df[k].eqNullSafe(named[f"_of_{k}"]) for k in keys]).drop(*(f"_of_{k}" for k in keys))


def _heads(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def reference_matrices(reference: DataFrame, on: list[str], chan: str) -> tuple[DataFrame, DataFrame]:
    """(on, chan, c, n), the place of each channel, and (on, matrix), from rows (on, a, b, cov) of either or both triangles.

    A pair that is given twice has its mean, one that is missing 0."""
    both = reference.select(*on, "a", "b", "cov").dropna()
    both = both.unionByName(both.where("a <> b").select(*on, F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    both = cut(both)
    names = both.groupBy(*on).agg(F.array_sort(F.collect_set("a")).alias("names"))
    places = names.select(*on, F.size("names").alias("n"), F.posexplode("names").alias("c", chan))
    at = both.groupBy(*on, "a", "b").agg(F.avg("cov").alias("cov")).join(places.withColumnRenamed(chan, "a").withColumnRenamed("c", "ca"), [*on, "a"])
    at = at.join(places.select(*on, F.col(chan).alias("b"), F.col("c").alias("cb")), [*on, "b"])
    entries = at.groupBy(*on).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("ca") * F.col("n") + F.col("cb"), "cov"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return places, entries.select(*on, cells.alias("matrix"))


def shifted_epochs(df: DataFrame, keys: list[str], size: int, t: str = "t") -> DataFrame:
    """Rows as members of epochs of two streams, with ``stream``, ``epoch`` and ``weight``; weights of a row add up to 1.

    Times count from 0. Unlike ``segment.half_shift_epochs`` nothing is left out: the last epoch of the first stream is longer."""
    half = size // 2
    last = F.greatest(F.floor((F.col("_end") + 1) / size) - 1, F.lit(0))
    ends = df.groupBy(*keys).agg(F.max(t).alias("_end"))
    rows = _attach(df, ends, keys).withColumn("_last", last)
    inside = (F.col(t) >= half) & (F.col(t) < F.col("_last") * size + half)
    streams = F.when(inside, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("stream", F.explode(streams))
    epoch = F.least(F.floor((F.col(t) - F.col("stream") * half) / size), F.col("_last"))
    place = F.pmod(F.col(t) - F.col("stream") * half, F.lit(size))
    weight = F.when(inside, 0.5 - 0.5 * F.cos(2 * math.pi * (place + 1) / size)).otherwise(1.0)
    return rows.withColumn("epoch", epoch).withColumn("weight", weight).drop("_end", "_last")


def _epochs(samples: DataFrame, keys: list[str], matrices: DataFrame, on: list[str], size: int) -> DataFrame:
    """(keys, stream, epoch, times, weights, x, powers, stay, go): an epoch a row; ``x`` is channels by times, null where no sample is."""
    rows = shifted_epochs(samples, keys, size)
    group = [*keys, "stream", "epoch"]

    heads = _heads(rows, group)
    lists = "times array<bigint>, weights array<double>, x array<double>"
    made = f"{heads}, {lists}, cov array<double>, faded array<double>"
    fields = to_arrow_schema(T._parse_datatype_string(made))

    def build(key, part):
        t, c, weight, v = (part.column(k).to_numpy() for k in ("t", "c", "weight", "x"))
        times, at = np.unique(t, return_inverse=True)
        n = part.column("n")[0].as_py()
        x, count, weights = np.zeros((n, len(times))), np.zeros((n, len(times))), np.zeros(len(times))
        np.add.at(x, (c, at), v.astype(float))
        np.add.at(count, (c, at), 1)
        weights[at] = weight
        x /= np.maximum(count, 1)
        row = (times, weights, np.where(count > 0, x, np.nan).ravel(), _cov(x).ravel(), _cov(x * weights).ravel())
        values = [*([k.as_py()] for k in key), *([v] for v in row)]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], schema=fields)

    members = rows.select(*group, F.col("t").cast("long").alias("t"), "c", "n", "weight", F.col("x").cast("double").alias("x"))
    made = members.groupBy(*group).applyInArrow(build, made)

    def judge(parts):
        for p in parts:
            out = []
            for cov, faded, ref in zip(p["cov"], p["faded"], p["matrix"], strict=True):
                n = int(round(math.sqrt(len(cov))))
                powers, stay, go = outcomes(*(np.asarray(m, float).reshape(n, n) for m in (cov, faded)), regularised(np.asarray(ref, float).reshape(n, n)))
                out.append((np.abs(powers).tolist(), stay, go))
            powers, stay, go = zip(*out, strict=True) if out else ((), (), ())
            yield p.drop(columns=["cov", "faded"]).assign(powers=list(powers), stay=list(stay), go=list(go))

    return cut(_attach(made, matrices, on).mapInPandas(judge, f"{heads}, {lists}, matrix array<double>, powers array<double>, stay array<double>, go array<double>"))


def usual_powers(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stream, base): the least logarithm of a power beyond the usual ones, or the greatest where none is.

    Ranks are exact to a ten-thousandth, whatever the number of epochs."""
    by = [*keys, "stream"]
    logs = epochs.select(*by, F.explode("powers").alias("p")).where("p > 0").select(*by, (F.log("p") + SHIFT).alias("v"))
    usual = logs.groupBy(*by).agg(F.percentile_approx("v", F.lit(SHARE), F.lit(10_000)).alias("q"))
    beyond = _attach(logs, usual, by).groupBy(*by).agg(F.min(F.when(F.col("v") > F.col("q"), F.col("v"))).alias("next"), F.max("v").alias("most"))
    return beyond.select(*by, F.coalesce("next", "most").alias("base"))


def power_limit(base: Column, threshold: Column) -> Column:
    """The power from which components go; a higher threshold takes more."""
    return F.exp((105 - threshold) / 100 * base - SHIFT)


def threshold_scores(epochs: DataFrame, base: DataFrame, thresholds: DataFrame, keys: list[str], noise_weight: float) -> DataFrame:
    """(keys, threshold, score) for rows (keys, threshold): 100 times the mean over epochs of the first stream of the likeness
    of what stays, less ``noise_weight`` times that of what goes."""
    first = epochs.where("stream = 0").select(*keys, "powers", "stay", "go")
    tried = _attach(base.where("stream = 0").drop("stream"), thresholds, keys)
    limits = tried.select(*keys, "threshold", power_limit(F.col("base"), F.col("threshold")).alias("limit"))
    grid = limits.groupBy(*keys).agg(F.collect_list(F.struct("threshold", "limit")).alias("grid"))
    rows = _attach(first, grid, keys).select(*keys, "powers", "stay", "go", F.inline("grid"))
    gone = F.size(F.filter("powers", lambda p: p >= F.col("limit"))) + 1
    rows = rows.select(*keys, "threshold", F.element_at("stay", gone).alias("stay"), F.element_at("go", gone).alias("go"))
    return rows.groupBy(*keys, "threshold").agg((100 * (F.avg("stay") - noise_weight * F.avg("go"))).alias("score"))


def best_thresholds(epochs: DataFrame, base: DataFrame, keys: list[str], noise_weight: float, low: float, high: float, step: float) -> DataFrame:
    """(keys, threshold, score): the best of the whole grid from ``low`` to ``high``, then of ten times finer steps around it.

    The grid is tried in full, so a score with several peaks does no harm. Of equal scores the least threshold wins, which takes
    out least."""

    def best(tried: DataFrame) -> DataFrame:
        scores = threshold_scores(epochs, base, tried, keys, noise_weight)
        top = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("threshold")).alias("less")))
        return scores.groupBy(*keys).agg(top.alias("top")).select(*keys, (-F.col("top.less")).alias("threshold"), F.col("top.score").alias("score"))

    def around(centre: Column, first: int, last: int, width: float) -> Column:
        return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), centre + k * width)))

    every = base.select(*keys).distinct()
    coarse = cut(best(every.select(*keys, F.explode(around(F.lit(float(low)), 0, math.ceil((high - low) / step), step)).alias("threshold"))))
    return cut(best(coarse.select(*keys, F.explode(F.array_distinct(around(F.col("threshold"), -10, 10, step / 10))).alias("threshold"))))


def _clean(epochs: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c, t, x): epochs without what reaches their limit, both streams put together."""
    rows = _attach(epochs.drop("stay", "go"), limits, [*keys, "stream"])

    def take_out(parts):
        for p in parts:
            for first in range(0, len(p), SLICE):
                some, found = p.iloc[first : first + SLICE], []
                for times, weights, raw, matrix, powers, limit in zip(*(some[c] for c in ("times", "weights", "x", "matrix", "powers", "limit")), strict=True):
                    n = int(round(math.sqrt(len(matrix))))
                    raw = np.asarray(raw, float).reshape(n, len(times))
                    x = np.nan_to_num(raw)
                    gone = int((np.asarray(powers) >= limit).sum())
                    if gone:
                        _, filters, patterns = generalised(_cov(x), regularised(np.asarray(matrix, float).reshape(n, n)))
                        x = x - patterns[:, :gone] @ (filters[:, :gone].T @ x)
                    c, at = np.nonzero(~np.isnan(raw))
                    found.append((c, np.asarray(times)[at], x[c, at] * np.asarray(weights)[at]))
                sizes = [len(c) for c, _, _ in found]
                c, t, x = (np.concatenate(v) for v in zip(*found, strict=True))
                own = some[keys].iloc[np.repeat(np.arange(len(some)), sizes)].reset_index(drop=True)
                yield own.assign(c=c, t=t, x=x)[[*keys, "c", "t", "x"]]

    parts = rows.select(*keys, "times", "weights", "x", "matrix", "powers", "limit").mapInPandas(take_out, f"{_heads(rows, keys)}, c int, t bigint, x double")
    return parts.groupBy(*keys, "c", "t").agg(F.sum("x").alias("x"))


def _band(samples: DataFrame, keys: list[str], matrices: DataFrame, on: list[str], size: int, noise_weight: float, threshold: float | None, low: float, high: float, step: float) -> tuple[DataFrame, DataFrame]:
    epochs = _epochs(samples, keys, matrices, on, size)
    base = cut(usual_powers(epochs, keys))
    if threshold is None:
        chosen = best_thresholds(epochs, base, keys, noise_weight, low, high, step).drop("score")
    else:
        chosen = base.select(*keys).distinct().withColumn("threshold", F.lit(float(threshold)))
    # Reported scores weigh what goes once, so that bands and weights can be compared.
    found = cut(threshold_scores(epochs, base, chosen, keys, 1.0))
    limits = _attach(base, chosen, keys).select(*keys, "stream", power_limit(F.col("base"), F.col("threshold")).alias("limit"))
    every = epochs.select(*keys, "stream").distinct()
    # Epochs without any power have no limit, and nothing to take out.
    both = [*keys, "stream"]
    return _clean(epochs, limits.unionByName(_missing(every, limits, both).withColumn("limit", F.lit(float("inf")))), keys), found


def _missing(every: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    named = some.select(*(F.col(k).alias(f"_of_{k}") for k in keys))
    return every.join(named, [every[k].eqNullSafe(named[f"_of_{k}"]) for k in keys], "left_anti")


def denoise(
    df: DataFrame,
    keys: list[str],
    reference: DataFrame,
    size: int,
    srate: float,
    levels: int = 3,
    noise_weight: float = 3.0,
    threshold: float | None = None,
    low: float = 0.0,
    high: float = 12.0,
    step: float = 0.25,
    chan: str = "chan",
    t: str = "t",
    value: str = "x",
) -> tuple[DataFrame, DataFrame]:
    """((keys, chan, t, value) cleaned, (keys, band, threshold, score)) of recordings against their reference.

    ``reference``: rows (some or all of the keys, a, b, cov), the covariance that channels have by the sources' geometry. At
    least one key must be there, such as a montage, so that many references are joined like any table. ``size``: even number of
    samples of an epoch. Samples less the mean over channels (with one more channel that is 0) are cleaned as a whole (band
    ``all``), then by Haar bands of ``levels``, of which the ceil(600 / srate) slowest are left as they are; bands add up.
    All bands are searched and cleaned in one job. ``noise_weight`` 1, 3 or 6 takes out less and less; a ``threshold`` is used
    in place of the search from ``low`` to ``high``."""
    on = [k for k in keys if k in reference.columns]
    if not on:
        raise ValueError("reference needs one of the keys")
    if size < 4 or size % 2:
        raise ValueError("size must be even, and at least 4")
    places, matrices = (cut(x) for x in reference_matrices(reference, on, chan))
    rows = df.select(*keys, chan, t, value)
    ok = F.col(t).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)
    known = rows.where(ok).join(places.select(*on, chan).withColumn("_known", F.lit(True)), [*on, chan], "left")
    others = known.where("_known is null").select(*rows.columns).unionByName(rows.where(~ok))
    samples = rows.where(ok).join(places, [*on, chan]).groupBy(*keys, "c", "n", F.col(t).cast("long").alias("t")).agg(F.avg(value).alias("x"))
    samples = average_reference(samples, [*keys, "t"], full_rank=True)
    options = (size, noise_weight, threshold, low, high, step)
    broad, found = _band(samples, keys, matrices, on, *options)
    broad = _attach(cut(broad), _counts(matrices), on)

    names = [*(f"d{k}" for k in range(1, levels + 1)), f"a{levels}"]
    kept = min(len(names), math.ceil(600 / srate))
    cleaned = names[: len(names) - kept]
    split = haar_levels(broad, [*keys, "c"], levels, "t")
    split = cut(split.select(*keys, "c", "n", "t", F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("x")) for b in names)))))
    parts = split.where(~F.col("band").isin(cleaned)).select(*keys, "c", "t", "x")
    found = found.withColumn("band", F.lit("all"))
    if cleaned:
        fast, more = _band(split.where(F.col("band").isin(cleaned)), [*keys, "band"], matrices, on, *options)
        parts = parts.unionByName(fast.select(*keys, "c", "t", "x"))
        found = found.unionByName(more)
    whole = parts.groupBy(*keys, "c", "t").agg(F.sum("x").alias("x"))
    out = whole.join(places.drop("n"), [*on, "c"]).select(*keys, chan, F.col("t").cast(df.schema[t].dataType).alias(t), F.col("x").alias(value))
    return out.unionByName(others), found.select(*keys, "band", "threshold", "score")


def _counts(matrices: DataFrame) -> DataFrame:
    return matrices.select(*(c for c in matrices.columns if c != "matrix"), F.sqrt(F.size("matrix").cast("double")).cast("int").alias("n"))


def denoising_score(df: DataFrame, cleaned: DataFrame, keys: list[str], reference: DataFrame, size: int, noise_weight: float = 1.0, chan: str = "chan", t: str = "t", value: str = "x") -> DataFrame:
    """(keys, score): likeness of the cleaned samples to the reference less that of what was taken out of ``df``, over whole epochs.

    Samples that only one of the two has are left out."""
    on = [k for k in keys if k in reference.columns]
    places, matrices = (cut(x) for x in reference_matrices(reference, on, chan))
    after = cleaned.select(*keys, chan, t, F.col(value).alias("_after"))
    rows = df.select(*keys, chan, t, value).join(after, [*keys, chan, t]).join(places, [*on, chan])
    rows = rows.dropna().select(*keys, F.floor(F.col(t) / size).alias("epoch"), F.col(t).cast("long").alias("t"), "c", "n", F.col(value).alias("x"), "_after")
    group = [*keys, "epoch"]

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        times, at = np.unique(part["t"].to_numpy(), return_inverse=True)
        x, y = np.zeros((2, int(part["n"].iloc[0]), len(times)))
        x[part["c"], at], y[part["c"], at] = part["x"], part["_after"]
        return pd.DataFrame([(*key, _cov(y).ravel().tolist(), _cov(x - y).ravel().tolist())], columns=[*group, "stay", "go"])

    made = rows.groupBy(*group).applyInPandas(lambda key, part: build(key, part), f"{_heads(rows, group)}, stay array<double>, go array<double>")

    def judge(parts):
        for p in parts:
            out = []
            for stay, go, ref in zip(p["stay"], p["go"], p["matrix"], strict=True):
                n = int(round(math.sqrt(len(stay))))
                template = np.linalg.eigh(regularised(np.asarray(ref, float).reshape(n, n)))[1][:, -min(TOP, n) :]
                a, b = (np.asarray(m, float).reshape(n, n) for m in (stay, go))
                out.append(100 * (likeness(a, template) - noise_weight * likeness(b, template, False)))
            yield p[keys].assign(score=out)

    return _attach(made, matrices, on).mapInPandas(judge, f"{_heads(rows, keys)}, score double").groupBy(*keys).agg(F.avg("score").alias("score"))
