import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import denoising

SIZE = 16


def recording(samples, chans=5, bursts=(), seed=0):
    r = np.random.default_rng(seed)
    mix = 0.6 ** np.abs(np.subtract.outer(np.arange(chans), np.arange(chans)))
    x = np.linalg.cholesky(mix) @ r.normal(size=(chans, samples))
    for start, stop in bursts:
        x[1, start:stop] += 40 * np.sin(np.arange(stop - start) * 1.3)
        x[3, start:stop] -= 25 * np.sin(np.arange(stop - start) * 1.3)
    return x, mix


def frame(spark, recs):
    rows = [(k, f"c{i}", t, float(x[i, t])) for k, x in recs.items() for i in range(x.shape[0]) for t in range(x.shape[1])]
    return spark.createDataFrame(rows, "rec string, chan string, t long, x double")


def table(spark, mixes):
    rows = [(k, f"c{i}", f"c{j}", float(m[i, j])) for k, m in mixes.items() for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, "rec string, a string, b string, cov double")


def wide(clean, rec, shape):
    out = np.full(shape, np.nan)
    for r in clean.where(F.col("rec") == rec).collect():
        out[int(r["chan"][1:]), r["t"]] = r["x"]
    return out


# --- plain versions, by samples and one threshold at a time ---------------------------------------------------------
def slow_streams(x, size):
    n, half = x.shape[1], size // 2
    last = max(n // size - 1, 0)
    edges = [k * size for k in range(last + 1)] + [n]
    first = [(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    second = [(half + k * size, half + (k + 1) * size) for k in range(last)]
    w2 = np.zeros(n)
    for a, b in second:
        w2[a:b] = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(b - a) + 1) / size)
    return [(first, 1 - w2), (second, w2)]


def slow_solve(x, ref):
    cov = np.cov(x)
    p, v = np.linalg.eig(np.linalg.solve(ref, cov))
    order = np.argsort(-p.real)
    return p.real[order], v.real[:, order]


def slow_similar(x, ref, whole, top=3):
    rank = 0 if np.abs(x).max() < 1e-12 else min(top, np.linalg.matrix_rank(np.cov(x), tol=1e-9))
    if rank == 0 or (whole and rank < top):
        return 0.0
    a = np.linalg.svd(np.cov(x))[0][:, :rank]
    b = np.linalg.svd(ref)[0][:, :top]
    return np.prod(np.clip(np.linalg.svd(a.T @ b)[1], 0, 1))


def slow_limit(powers, threshold):
    v = np.sort(np.log(np.abs(powers[np.abs(powers) > 0])) + 100)
    q = v[math.ceil(0.95 * len(v)) - 1]
    return math.exp((105 - threshold) / 100 * (v[v > q].min() if (v > q).any() else v.max()) - 100)


def slow_taken(x, spans, ref, threshold):
    solved = [slow_solve(x[:, a:b], ref) for a, b in spans]
    limit = slow_limit(np.concatenate([p for p, _ in solved]), threshold)
    out = np.zeros_like(x)
    for (a, b), (p, v) in zip(spans, solved, strict=True):
        s = v.T @ x[:, a:b]
        s[np.abs(p) < limit] = 0
        out[:, a:b] = np.linalg.solve(v.T, s)
    return out


def slow_score(x, spans, weights, ref, threshold, noise_weight):
    taken = slow_taken(x, spans, ref, threshold)
    left = (x - taken) * weights
    stay = [slow_similar(left[:, a:b], ref, True) for a, b in spans]
    go = [slow_similar(taken[:, a:b], ref, False) for a, b in spans]
    return 100 * (np.mean(stay) - noise_weight * np.mean(go))


def slow_denoise(x, ref, size, threshold):
    (first, w1), (second, w2) = slow_streams(x, size)
    out = (x - slow_taken(x, first, ref, threshold)) * w1
    return out + (x - slow_taken(x, second, ref, threshold)) * w2 if second else out


def slow_bands(x, levels):
    bands, a = [], x
    for k in range(levels):
        before = np.concatenate([np.repeat(a[:, :1], 1 << k, axis=1), a], axis=1)[:, : x.shape[1]]
        bands.append(a - (a + before) / 2)
        a = (a + before) / 2
    return [*bands, a]


def test_whole_result_equals_the_plain_version(spark):
    x, mix = recording(SIZE * 9 + 5, bursts=[(20, 60), (100, 110)])
    clean, found = denoising.denoise(frame(spark, {"r": x}), ["rec"], table(spark, {"r": mix}), SIZE, 300.0, threshold=4.0)
    ref = 0.95 * mix + 0.05 * np.linalg.eigvalsh(mix).mean() * np.eye(5)
    y = slow_denoise(x - x.sum(axis=0) / 6, ref, SIZE, 4.0)
    bands = slow_bands(y, 3)
    want = sum(slow_denoise(b, ref, SIZE, 4.0) for b in bands[:2]) + bands[2] + bands[3]
    assert np.abs(wide(clean, "r", x.shape) - want).max() < 1e-6
    assert {(r["rec"], r["band"], r["threshold"]) for r in found.collect()} == {("r", b, 4.0) for b in ("all", "d1", "d2")}


def test_search_equals_a_search_through_all_thresholds(spark):
    x, mix = recording(SIZE * 12, bursts=[(20, 60), (100, 130)], seed=3)
    z, mix2 = recording(SIZE * 7, seed=5)
    _, found = denoising.denoise(frame(spark, {"r": x, "s": z}), ["rec"], table(spark, {"r": mix, "s": mix2}), SIZE, 300.0)
    got = {(r["rec"], r["band"]): r["threshold"] for r in found.collect()}
    for rec, (y, m) in {"r": (x, mix), "s": (z, mix2)}.items():
        ref = 0.95 * m + 0.05 * np.linalg.eigvalsh(m).mean() * np.eye(5)
        y = y - y.sum(axis=0) / 6
        first, w = slow_streams(y, SIZE)[0]
        fine = np.arange(0, 12.0001, 0.025)
        scores = np.array([slow_score(y, first, w, ref, t, 3.0) for t in fine])
        at = got[rec, "all"]
        assert abs(slow_score(y, first, w, ref, at, 3.0) - scores.max()) < 1e-6 or min(abs(fine[scores > scores.max() - 1e-9] - at)) <= 0.25
        coarse = scores[::10]
        assert slow_score(y, first, w, ref, at, 3.0) >= coarse.max() - 1e-6


def test_bursts_go_and_the_rest_stays(spark):
    x, mix = recording(SIZE * 40, bursts=[(100, 140), (400, 430)], seed=1)
    calm, _ = recording(SIZE * 40, seed=1)
    df, ref = frame(spark, {"r": x}), table(spark, {"r": mix})
    clean, _ = denoising.denoise(df, ["rec"], ref, SIZE, 300.0)
    y = wide(clean, "r", x.shape)
    calm, mixed = (v - v.sum(axis=0) / 6 for v in (calm, x))
    inside = np.r_[104:136, 404:426]
    assert np.abs(y - calm)[:, inside].mean() < 0.15 * np.abs(mixed - calm)[:, inside].mean()
    quiet = np.r_[160:380, 460:640]
    assert np.abs(y - calm)[:, quiet].mean() < 0.35 * np.abs(calm[:, quiet]).mean()
    before = frame(spark, {"r": mixed})
    score = denoising.denoising_score(before, clean, ["rec"], ref, SIZE).first()["score"]
    assert -100 <= score <= 100 and score > denoising.denoising_score(before, before, ["rec"], ref, SIZE).first()["score"] - 100


def test_odd_rows(spark):
    x, mix = recording(SIZE * 4, bursts=[(10, 30)])
    df, ref = frame(spark, {"r": x}), table(spark, {"r": mix, "none": mix})
    odd = spark.createDataFrame([("r", "zz", 3, 1.0), ("r", "c1", None, 2.0), ("r", None, 4, 5.0), ("r", "c0", 999, None), (None, "c0", 0, 7.0), ("r", "c2", 998, float("nan")), ("absent", "c0", 0, 3.0)], df.schema)
    plain, _ = denoising.denoise(df, ["rec"], ref, SIZE, 300.0)
    extra = df.unionByName(odd).unionByName(df.where("t = 7"))  # and repeated rows
    clean, _ = denoising.denoise(extra.withColumns({"stream": F.lit("s"), "epoch": F.lit(None), "n": F.lit(3), "c": F.lit(1), "matrix": F.lit(0)}), ["rec"], ref, SIZE, 300.0)
    key = lambda rows: sorted(map(str, rows))
    wanted = plain.collect()
    assert len(wanted) == x.size
    same = clean.join(plain.withColumnRenamed("x", "y"), ["rec", "chan", "t"])
    assert same.count() == x.size and same.where("abs(x - y) > 1e-9").isEmpty()
    assert key(clean.join(plain, ["rec", "chan", "t"], "left_anti").collect()) == key(odd.collect())
    none, found = denoising.denoise(df.limit(0), ["rec"], ref, SIZE, 300.0)
    assert none.isEmpty() and found.isEmpty() and none.columns == ["rec", "chan", "t", "x"]
    none, _ = denoising.denoise(df, ["rec"], ref.limit(0), SIZE, 300.0)
    assert key(none.collect()) == key(df.collect())


def test_gaps_flat_and_short_recordings(spark):
    x, mix = recording(SIZE * 4)
    df = frame(spark, {"flat": x * 0, "short": x[:, :5], "gap": x}).where("rec <> 'gap' or t < 20 or t >= 40")
    clean, found = denoising.denoise(df, ["rec"], table(spark, dict.fromkeys(("flat", "short", "gap"), mix)), SIZE, 300.0)
    assert clean.count() == df.count()
    assert clean.where("rec = 'flat' and x <> 0").isEmpty() and clean.where("x is null or isnan(x)").isEmpty()
    assert found.where("rec = 'gap'").count() == 3


def test_arguments(spark):
    x, mix = recording(8)
    df, ref = frame(spark, {"r": x}), table(spark, {"r": mix})
    with pytest.raises(ValueError, match="keys"):
        denoising.denoise(df, ["rec"], ref.drop("rec"), SIZE, 300.0)
    with pytest.raises(ValueError, match="even"):
        denoising.denoise(df, ["rec"], ref, 15, 300.0)


def test_outcomes_of_an_epoch_are_judged_together():
    r = np.random.default_rng(8)
    m = r.normal(size=(9, 6, 6))
    covs = m @ m.transpose(0, 2, 1)
    covs[3] = np.outer(m[3, 0], m[3, 0])  # one direction
    covs[5] = 0
    template = np.linalg.qr(r.normal(size=(6, 3)))[0]
    for whole in (True, False):
        got = denoising.likenesses(covs, template, whole)
        for cov, found in zip(covs, got, strict=True):
            p, v = np.linalg.eigh(cov)
            k = min(3, int((p > 1e-12 * max(p[-1], 1e-300)).sum()))
            want = 0.0 if k == 0 or (whole and k < 3) else np.prod(np.linalg.svd(v[:, -k:].T @ template, compute_uv=False))
            assert abs(found - want) < 1e-12
