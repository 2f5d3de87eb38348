"""Queries on several channels at once; checked by tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from signalspark.functions.arrays import rnd
from signalspark.operators import cardiac, cleaning, denoising, graph, lineage, series, subspace
from signalspark.operators import multichannel as mc
from signalspark.plans.catalog_graph import GRAPH, _channels, _graph
from signalspark.plans.catalog_series import _two_types
from signalspark.plans.registry import query


@query()
def subspace_cleaning(spark, d):
    """Artifact subspace reconstruction of the channels of each class by a moving covariance."""
    x = _channels(spark, d)
    out = subspace.subspace_clean(x, subspace.subspace_model(x, ["label"], 64, 3.0), ["label"], window=128, step=32, ahead=64)
    return out.select("label", "chan", "t", rnd(F.col("x")).alias("x"))


def _others(x):
    """(label, a, b, cov): covariances of the channels over the samples of all other classes."""
    a, b = (x.select("label", "t", F.col("chan").alias(c), F.col("x").alias(v)) for c, v in (("a", "u"), ("b", "v")))
    own = a.join(b, ["label", "t"]).groupBy("label", "a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("s"), F.count("*").alias("n"))
    every = own.groupBy("a", "b").agg(F.sum("s").alias("ss"), F.sum("n").alias("nn"))
    return own.join(every, ["a", "b"]).select("label", "a", "b", ((F.col("ss") - F.col("s")) / F.greatest(F.col("nn") - F.col("n"), F.lit(1))).alias("cov"))


def _denoised(spark, d):
    x = _channels(spark, d)
    return x, _others(x), *denoising.denoise(x, ["label"], _others(x), 64, 300.0)


@query()
def reference_denoising(spark, d):
    """Components far above the covariance of the other classes taken out, as a whole and by Haar bands, limits by search."""
    _, _, clean, _ = _denoised(spark, d)
    return clean.select("label", "chan", "t", rnd(F.col("x")).alias("x"))


@query()
def denoising_limits(spark, d):
    """Thresholds that the search finds per class and band, with their scores."""
    _, _, _, found = _denoised(spark, d)
    return found.select("label", "band", rnd(F.col("threshold"), 4).alias("threshold"), rnd(F.col("score"), 4).alias("score"))


@query()
def denoising_scores(spark, d):
    """How much more alike the reference the cleaned samples are than what was taken out, per class."""
    x, ref, clean, _ = _denoised(spark, d)
    x = cleaning.average_reference(x, ["label", "t"], full_rank=True)
    return denoising.denoising_score(x, clean, ["label"], ref, 64).select("label", rnd(F.col("score"), 4).alias("score"))


@query()
def independent_sources(spark, d):
    """Kurtosis of the independent components of each segment."""

    def kernel(m, chans, times, key):
        s, _ = mc.independent_components(m)
        k = (s**4).mean(axis=1) / (s**2).mean(axis=1) ** 2 - 3
        return pd.DataFrame({"component": range(len(k)), "kurtosis": sorted(k)})

    x = mc.with_segments(_channels(spark, d), 512)
    out = mc.map_segments(x, ["label", "segment"], kernel, "component int, kurtosis double")
    return out.select("label", "segment", "component", rnd(F.col("kurtosis"), 4).alias("kurtosis"))


@query()
def multichannel_lz(spark, d):
    """Lempel-Ziv complexity across channels per segment."""
    from signalspark.functions.kernels import multichannel_complexity

    x = mc.with_segments(_channels(spark, d), 256)
    out = mc.map_segments(x, ["label", "segment"], lambda m, c, t, k: pd.DataFrame({"lz": [multichannel_complexity(m)]}), "lz double")
    return out.select("label", "segment", rnd(F.col("lz")).alias("lz"))


@query()
def perturbational_complexity(spark, d):
    """Complexity of the second half of each segment against the first."""
    x = mc.with_segments(_channels(spark, d), 128)
    out = mc.map_segments(x, ["label", "segment"], lambda m, c, t, k: pd.DataFrame({"pci": [mc.response_complexity(m, m.shape[1] // 2, 0.2)]}), "pci double")
    return out.select("label", "segment", rnd(F.col("pci")).alias("pci"))


@query(
    "WITH RECURSIVE "
    + GRAPH
    + """, st AS (SELECT nd.g, nd.node, COALESCE(SUM(w), 0) / MAX(n) AS s FROM nd JOIN nn USING (g) LEFT JOIN (SELECT g, a, w FROM we UNION ALL SELECT g, b, w FROM we) u ON u.g = nd.g AND u.a = nd.node GROUP BY 1, 2),
dv AS (SELECT g, node, s - AVG(s) OVER (PARTITION BY g) AS v FROM st),
sp AS (SELECT MAX(ABS(v)) / 9.5 AS step FROM dv),
lv AS (SELECT g, node, SIGN(v) AS side, UNNEST(range(1, CEIL(ABS(v) / step)::BIGINT)) AS level FROM dv, sp),
reach(g, side, level, a, b) AS (SELECT g, side, level, node, node FROM lv
  UNION SELECT r.g, r.side, r.level, r.a, bw.b FROM reach r JOIN bw ON bw.g = r.g AND bw.a = r.b JOIN lv ON lv.g = r.g AND lv.side = r.side AND lv.level = r.level AND lv.node = bw.b),
cl AS (SELECT g, side, level, a AS node, COUNT(*) AS size FROM reach GROUP BY 1, 2, 3, 4),
sc AS (SELECT g, node, SUM(side * SQRT(size) * POWER(level * step, 2) * step) AS score FROM cl, sp GROUP BY 1, 2)
SELECT g, node, ROUND(COALESCE(score, 0), 4) + 0.0 AS score FROM dv LEFT JOIN sc USING (g, node)"""
)
def cluster_enhancement(spark, d):
    """Node strengths above and below the graph's mean, enhanced by clusters over the graph's own edges."""
    e, n = _graph(spark, d)
    strength = graph.intensity(e, n, ["g"]).select("g", "node", F.col("intensity").alias("v"))
    strength = lineage.cut(series.with_stats(strength, ["g"], centre=F.avg("v")).select("g", "node", (F.col("v") - F.col("centre")).alias("v")))
    edges = graph.both_ways(graph.percentile_graph(e, n, ["g"]), ["g"], "w").select("g", "a", "b")
    step = (strength.agg(F.max(F.abs("v"))).first()[0] or 9.5) / 9.5
    out = mc.tfce(strength, edges, ["g"], step, both=True)
    return out.select("g", "node", rnd(F.col("score"), 4).alias("score"))


@query()
def lagged_ridge(spark, d):
    """Ridge regression of one series on another at three lags, over all users."""
    left, right = _two_types(spark, d)
    x = cardiac.lag_design(left.withColumn("y", F.sin(F.col("t") / 9e4)), right.withColumnRenamed("last_x", "x"), ["user_id"], [0.0, 43200.0, 86400.0])
    x = x.withColumn("g", F.col("user_id") % 5)
    out = mc.ridge(x, ["g"], ["lag0", "lag1", "lag2"], "y", [1e-3, 1e-2, 1e-1, 1.0, 10.0])
    return out.select("g", "alpha", rnd(F.col("r2")).alias("r2"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))
