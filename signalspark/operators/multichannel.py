"""Operators that need all channels of a stretch of time at once.

A stretch is a segment of bounded length; recordings are cut into segments first (``with_segments``), so a task
holds channels x segment samples and not a recording. What is learned from a whole recording (covariances,
thresholds) comes from distributed aggregates of block statistics (``subspace``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators.graph import components


def with_segments(df: DataFrame, size: int, overlap: int = 0, t: str = "t") -> DataFrame:
    """Rows with their segment; with an overlap the first ``overlap`` samples also belong to the segment before."""
    seg = F.floor(F.col(t) / size)
    if not overlap:
        return df.withColumn("segment", seg)
    both = F.when((F.col(t) - seg * size < overlap) & (seg > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))
    return df.withColumn("segment", F.explode(both))


def map_segments(df: DataFrame, keys: list[str], kernel: Callable[[np.ndarray, list, np.ndarray, dict], pd.DataFrame], schema: str, chan: str = "chan", t: str = "t", value: str = "x") -> DataFrame:
    """``kernel(matrix channels x times, channels, times, key values)`` per group; missing samples are 0 to the kernel.

    Where the kernel returns samples (channel and time), those that were not in the input are left out."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index=chan, columns=t, values=value, aggfunc="mean", fill_value=0.0)
        out = kernel(wide.to_numpy(float), wide.index.tolist(), wide.columns.to_numpy(), dict(zip(keys, key, strict=True)))
        if chan in out and t in out:
            out = out.merge(part[[chan, t]].drop_duplicates(), on=[chan, t])
        return out.assign(**dict(zip(keys, key, strict=True)))

    full = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", {schema}"
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]
    return df.select(*keys, chan, t, value).groupBy(*keys).applyInPandas(lambda key, part: run(key, part)[names], full)


def long_frame(matrix: np.ndarray, channels: list, times: np.ndarray, chan: str = "chan", t: str = "t", value: str = "x") -> pd.DataFrame:
    return pd.DataFrame({chan: np.repeat(np.array(channels, dtype=object), len(times)), t: np.tile(times, len(channels)), value: matrix.ravel()}).infer_objects()


def geometric_median(points: np.ndarray, tol: float = 1e-5, max_iter: int = 500) -> np.ndarray:
    """Point of least summed distance, by Weiszfeld's iteration with Vardi and Zhang's step at data points."""
    y = points.mean(axis=0)
    for _ in range(max_iter):
        d = np.sqrt(((points - y) ** 2).sum(axis=1))
        apart = d > 1e-12
        if not apart.any():
            return y
        w = 1 / d[apart]
        new = (points[apart] * w[:, None]).sum(axis=0) / w.sum()
        at = (~apart).sum()
        if at:
            pull = np.sqrt((((points[apart] - y) * w[:, None]).sum(axis=0) ** 2).sum())
            part = min(1.0, at / pull) if pull > 0 else 1.0
            new = (1 - part) * new + part * y
        if np.sqrt(((new - y) ** 2).sum()) <= tol * max(1e-12, np.sqrt((y**2).sum())):
            return new
        y = new
    return y


# --- denoising against a reference covariance -----------------------------------------------------------------
def reference_denoise(x: np.ndarray, reference: np.ndarray, limit: float, mix: float = 0.05) -> np.ndarray:
    """A stretch without the generalised components whose power over the reference is ``limit`` or more.

    The reference is kept invertible by a share of its mean eigenvalue; whitening by Cholesky makes the problem an
    ordinary one."""
    n = len(x)
    ref = (1 - mix) * reference + mix * np.linalg.eigvalsh(reference).mean() * np.eye(n)
    c = x @ x.T / max(1, x.shape[1])
    low = np.linalg.cholesky(ref)
    inv = np.linalg.inv(low)
    w, v = np.linalg.eigh(inv @ c @ inv.T)
    filters = inv.T @ v
    bad = w >= limit
    if not bad.any():
        return x
    return x - (low @ v)[:, bad] @ (filters.T @ x)[bad]


def independent_components(x: np.ndarray, keep: float = 0.99, seed: int = 0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(sources, unmixing) by whitening and symmetric fixed-point iteration with tanh; the start is seeded."""
    x = x - x.mean(axis=1, keepdims=True)
    w, v = np.linalg.eigh(x @ x.T / x.shape[1])
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), keep) + 1)
    white = (v[:, :k] / np.sqrt(np.maximum(w[:k], 1e-12))).T
    z = white @ x

    def decorrelate(m):
        u, _, vt = np.linalg.svd(m, full_matrices=False)
        return u @ vt

    m = decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(rounds):
        g = np.tanh(m @ z)
        new = decorrelate(g @ z.T / z.shape[1] - (1 - g**2).mean(axis=1)[:, None] * m)
        done = np.abs(np.abs((new * m).sum(axis=1)) - 1).max() < 1e-6
        m = new
        if done:
            break
    return m @ z, m @ white


# --- clusters and perturbational complexity --------------------------------------------------------------------
def tfce(values: DataFrame, adjacency: DataFrame, keys: list[str], step: float, extent: float = 0.5, height: float = 2.0, both: bool = False) -> DataFrame:
    """(keys, node, score): threshold-free cluster enhancement of positive values (keys, node, v), or of ``both`` sides, each by
    itself, negative values with negative scores. ``adjacency`` (a, b, both ways) may have some or all of the keys; a node without
    a value or a neighbour scores by itself or 0.

    Thresholds step, 2 step, ... are rows; clusters of all thresholds are found together as components of the
    active nodes, and a node sums extent**E x h**H x step over the thresholds it passes."""
    if both:
        signed = values.withColumns({"_side": F.signum("v"), "v": F.abs("v")})
        scores = tfce(signed, adjacency, [*keys, "_side"], step, extent, height)
        return scores.select(*keys, "node", F.coalesce(F.col("score") * F.col("_side"), F.lit(0.0)).alias("score"))
    on = [k for k in keys if k in adjacency.columns]
    rows = values.where(F.col("v") > step).withColumn("level", F.explode(F.sequence(F.lit(1), F.ceil(F.col("v") / step).cast("int") - 1)))
    active = rows.select(*keys, "level", "node")
    a, b = active.withColumnRenamed("node", "a"), active.withColumnRenamed("node", "b")
    edges = a.join(adjacency, [*on, "a"]).join(b, [*keys, "level", "b"]).select(*keys, "level", "a", "b").where("a < b")
    found = components(edges, active, [*keys, "level"])
    sizes = found.groupBy(*keys, "level", "component").agg(F.count("*").alias("n"))
    h = F.col("level") * F.lit(float(step))
    part = F.pow(F.col("n").cast("double"), F.lit(extent)) * F.pow(h, F.lit(height)) * step
    scores = found.join(sizes, [*keys, "level", "component"]).groupBy(*keys, "node").agg(F.sum(part).alias("score"))
    return values.select(*keys, "node").join(scores, [*keys, "node"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def matrix_complexity(bits: np.ndarray) -> float:
    """Lempel-Ziv complexity of a binary matrix read column by column, over L H / log2 L."""
    from signalspark.functions.kernels import lempel_ziv

    flat = np.asarray(bits).T.ravel()
    p = flat.mean()
    if p in (0.0, 1.0):
        return 0.0
    h = -p * np.log2(p) - (1 - p) * np.log2(1 - p)
    return lempel_ziv(flat) * np.log2(len(flat)) / (len(flat) * h)


def response_complexity(x: np.ndarray, baseline: int, alpha: float = 0.01, draws: int = 200, seed: int = 0) -> float:
    """Complexity of the significant response: amplitudes after ``baseline`` samples above the (1 - alpha) quantile of
    the maxima over resampled baselines, rows ordered by activity."""
    base = x[:, :baseline]
    sigma = np.maximum(base.std(axis=1, ddof=1, keepdims=True), 1e-12)
    z = (x - base.mean(axis=1, keepdims=True)) / sigma
    r = np.random.default_rng(seed)
    maxima = [np.abs(z[:, r.integers(0, baseline, baseline)]).max() for _ in range(draws)]
    bits = np.abs(z[:, baseline:]) > np.quantile(maxima, 1 - alpha)
    return matrix_complexity(bits[np.argsort(bits.sum(axis=1), kind="stable")])


# --- regression from Gram sums ---------------------------------------------------------------------------------
def ridge(df: DataFrame, keys: list[str], xs: list[str], y: str, alphas: list[float]) -> DataFrame:
    """(keys, alpha, weights, r2): ridge regression with a constant, alpha by generalised cross-validation.

    One pass sums all products (partial aggregates, so rows never move); the small systems are solved from the sums.
    Rows with nulls are left out."""
    cols = [*xs, y]
    ok = df.dropna(subset=cols)
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]]
    g = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in cols)).alias("sums"), F.array(*products).alias("products"))
    k = len(xs)

    def solve(batches):
        for part in batches:
            rows = []
            for n, s, p in zip(part["n"], part["sums"], part["products"], strict=True):
                full = np.zeros((k + 1, k + 1))
                full[np.triu_indices(k + 1)] = p
                full = full + np.triu(full, 1).T - np.outer(s, s) / n
                w, v = np.linalg.eigh(full[:k, :k])
                w, c, yy = np.maximum(w, 0), v.T @ full[:k, k], full[k, k]
                best = None
                for a in alphas:
                    shrink = 1 / (w + a)
                    rss = yy - 2 * (c**2 * shrink).sum() + (c**2 * shrink**2 * w).sum()
                    free = n - 1 - (w * shrink).sum()
                    score = n * rss / free**2 if free > 0 else np.inf
                    if best is None or score < best[0]:
                        best = (score, a, v @ (c * shrink), 1 - rss / yy if yy > 0 else np.nan)
                rows.append((float(best[1]), best[2].tolist(), float(best[3])))
            alpha, weights, r2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield part[keys].assign(alpha=list(alpha), weights=list(weights), r2=list(r2))

    heads = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    return g.mapInPandas(solve, f"{heads}, alpha double, weights array<double>, r2 double")


# --- graphs in one task ----------------------------------------------------------------------------------------
def betweenness(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, betweenness): share of shortest paths through each node, per graph of channels.

    A graph has as many nodes as a recording has channels, which bounds what one task holds."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(part["a"]) | set(part["b"]))
        at = {v: i for i, v in enumerate(nodes)}
        n = len(nodes)
        adj = np.zeros((n, n))
        for a, b in zip(part["a"], part["b"], strict=True):
            adj[at[a], at[b]] = adj[at[b], at[a]] = 1
        score = np.zeros(n)
        for s in range(n):
            paths, depth, layers = np.zeros(n), np.full(n, -1), []
            paths[s], depth[s], front = 1, 0, np.array([s])
            while len(front):
                layers.append(front)
                into = paths[front] @ adj[front]
                new = np.flatnonzero((into > 0) & (depth < 0))
                depth[new] = len(layers)
                paths[new] = into[new]
                front = new
            credit = np.zeros(n)
            for up, down in zip(layers[-2::-1], layers[:0:-1], strict=True):
                credit[up] += paths[up] * (adj[np.ix_(up, down)] @ ((1 + credit[down]) / paths[down]))
            credit[s] = 0
            score += credit
        scale = (n - 1) * (n - 2)
        return pd.DataFrame({"node": nodes, "betweenness": score / scale if scale > 0 else score}).assign(**dict(zip(keys, key, strict=True)))[[*keys, "node", "betweenness"]]

    heads = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)
    return edges.select(*keys, "a", "b").groupBy(*keys).applyInPandas(run, f"{heads}, node {edges.schema['a'].dataType.simpleString()}, betweenness double")
