import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import graph, subspace
from signalspark.operators import multichannel as mc


def long(spark, x, key="r"):
    rows = [(key, c, t, float(x[c, t])) for c in range(x.shape[0]) for t in range(x.shape[1])]
    return spark.createDataFrame(rows, "rec string, chan int, t long, x double")


def test_subspace_cleaning_removes_a_burst_and_nothing_else(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(6, 6)) @ r.normal(size=(6, 1024))
    dirty = x.copy()
    dirty[:, 512:576] += 60 * r.normal(size=(6, 1)) * np.sin(np.arange(64) / 2)
    model = subspace.subspace_model(long(spark, x), ["rec"], 64, 6.0)
    got = subspace.subspace_clean(long(spark, dirty), model, ["rec"], 64, 16, 32).toPandas().pivot(index="chan", columns="t", values="x").to_numpy()
    assert np.abs(got[:, :448] - x[:, :448]).max() < 1e-8
    assert np.abs(got[:, 520:568]).max() < 0.3 * np.abs(dirty[:, 520:568]).max()


def test_geometric_median_ignores_outliers():
    r = np.random.default_rng(0)
    p = np.concatenate([r.normal(size=(200, 3)), 1000 + r.normal(size=(40, 3))])
    assert np.abs(mc.geometric_median(p)).max() < 1
    assert mc.geometric_median(np.array([[0.0, 0], [0, 0], [0, 0], [9, 9]])) == pytest.approx([0, 0], abs=1e-3)


def test_reference_denoising():
    r = np.random.default_rng(1)
    x = r.normal(size=(5, 400))
    artifact = np.outer(r.normal(size=5), 30 * np.sin(np.arange(400) / 3))
    got = mc.reference_denoise(x + artifact, np.eye(5), 5.0)
    assert np.abs(got).max() < 6
    assert mc.reference_denoise(x, np.eye(5), 5.0) is x


def test_independent_components_unmix():
    r = np.random.default_rng(2)
    s = np.stack([np.sign(np.sin(np.arange(4000) / 17)), r.laplace(size=4000), np.sin(np.arange(4000) / 5)])
    got, w = mc.independent_components(r.normal(size=(3, 3)) @ s, keep=0.99999)
    c = np.abs(np.corrcoef(np.concatenate([got, s]))[:3, 3:])
    assert (c.max(axis=0) > 0.95).all()


def test_enhancement_of_a_plateau(spark):
    v = spark.createDataFrame([("a", i, 1.0 if i in (2, 3, 4) else 0.0) for i in range(8)], "k string, node long, v double")
    ring = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(i + 1, i) for i in range(7)], "a long, b long")
    got = {r["node"]: r["score"] for r in mc.tfce(v, ring, ["k"], 0.25).collect()}
    want = sum(3**0.5 * (k * 0.25) ** 2 * 0.25 for k in (1, 2, 3))
    assert got[3] == pytest.approx(want) and got[0] == 0


def test_cluster_enhancement_of_both_sides_over_keyed_edges(spark):
    v = spark.createDataFrame([("k", i, x) for i, x in enumerate([1.0, 1.0, -1.0, -1.0, 0.0, 1.0])] + [("m", 0, 1.0), ("m", 1, 1.0), ("m", 2, None)], "k string, node long, v double")
    edges = [("k", i, i + 1) for i in range(5)]
    ring = spark.createDataFrame([e for k, a, b in edges for e in ((k, a, b), (k, b, a))], "k string, a long, b long")
    got = {(r["k"], r["node"]): r["score"] for r in mc.tfce(v, ring, ["k"], 0.4, both=True).collect()}
    one = sum((j * 0.4) ** 2 * 0.4 for j in (1, 2))
    two = 2**0.5 * one
    want = {("k", 0): two, ("k", 1): two, ("k", 2): -two, ("k", 3): -two, ("k", 4): 0, ("k", 5): one, ("m", 0): one, ("m", 1): one, ("m", 2): 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ridge_from_sums(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + 3 + 0.01 * r.normal(size=300)
    df = spark.createDataFrame([("a", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [("a", None, 1.0, 2.0)], "k string, p double, q double, y double")
    got = mc.ridge(df, ["k"], ["p", "q"], "y", [1e-6, 1.0, 100.0]).first()
    assert got["weights"] == pytest.approx([2, -1], abs=0.01) and got["r2"] > 0.99 and got["alpha"] == 1e-6


def test_betweenness_of_a_star_and_a_path(spark):
    e = spark.createDataFrame([("s", 0, i) for i in range(1, 5)] + [("p", i, i + 1) for i in range(4)], "g string, a long, b long")
    got = {(r["g"], r["node"]): r["betweenness"] for r in mc.betweenness(e, ["g"]).collect()}
    assert got["s", 0] == pytest.approx(1) and got["s", 1] == 0
    assert got["p", 2] == pytest.approx(8 / 12) and got["p", 1] == pytest.approx(6 / 12)


def test_two_cliques(spark):
    edges = [("g", a, b) for base in (0, 4) for a in range(base, base + 4) for b in range(a + 1, base + 4)]
    e = spark.createDataFrame(edges, "g string, a long, b long")
    n = spark.createDataFrame([("g", i) for i in range(8)], "g string, node long")
    assert {r["clustering"] for r in graph.clustering(e, n, ["g"]).collect()} == {1.0}
    assert {r["component"] for r in graph.components(e, n, ["g"]).collect()} == {0, 4}
    assert graph.global_efficiency(e, n, ["g"]).first()["efficiency"] == pytest.approx(24 / 56)


def test_complexity_of_matrices():
    r = np.random.default_rng(0)
    assert mc.matrix_complexity(np.zeros((4, 4))) == 0
    assert mc.matrix_complexity(r.integers(0, 2, (20, 200))) == pytest.approx(1, abs=0.15)
    assert mc.matrix_complexity(np.tile([0, 1], (20, 100))) < 0.2


def test_segments_overlap(spark):
    df = spark.range(10).select(F.col("id").alias("t"))
    got = mc.with_segments(df, 4, 1).groupBy("segment").count().orderBy("segment").collect()
    assert [(r[0], r[1]) for r in got] == [(0, 5), (1, 5), (2, 2)]


def test_absent_samples_are_not_invented(spark):
    r = np.random.default_rng(2)
    df = long(spark, r.normal(size=(4, 256))).where("not (chan = 2 and t between 70 and 90)")
    want = {(x["chan"], x["t"]) for x in df.collect()}
    model = subspace.subspace_model(df, ["rec"], 64, 6.0)
    got = subspace.subspace_clean(df, model, ["rec"], 64, 16, 32).collect()
    assert len(got) == len(want) and {(x["chan"], x["t"]) for x in got} == want
    same = mc.map_segments(mc.with_segments(df, 64), ["rec", "segment"], lambda m, c, t, k: mc.long_frame(m, c, t), "chan int, t long, x double").collect()
    assert len(same) == len(want) and {(x["chan"], x["t"]) for x in same} == want


def test_efficiency_of_a_long_path(spark):
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(8)], "g int, a int, b int")
    nodes = spark.createDataFrame([(0, k) for k in range(9)], "g int, node int")
    want = 2 * sum((9 - d) / d for d in range(1, 9)) / 72
    assert graph.global_efficiency(edges, nodes, ["g"]).first()["efficiency"] == pytest.approx(want)
    with pytest.raises(RuntimeError):
        graph.components(edges, nodes, ["g"], max_rounds=1)
