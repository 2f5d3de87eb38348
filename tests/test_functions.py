"""Closed-form signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.functions import arrays, kernels, nonlinear, spectral
from signalspark.operators import series
from signalspark.plans.features import generate_features
from signalspark.schema import FeatureSpec


@pytest.fixture(scope="module")
def signals(spark):
    t = np.arange(128) / 128
    r = np.random.default_rng(0)
    rows = [("sine", (np.sin(2 * np.pi * 10 * t)).tolist()), ("ramp", t.tolist()), ("flat", [1.0] * 128), ("noise", r.normal(size=128).tolist())]
    return spark.createDataFrame(rows, "name string, x array<double>").cache()


def value(df, column):
    return {r["name"]: r["v"] for r in df.select("name", column.alias("v")).collect()}


def test_spectrum_of_a_sine(signals):
    p = value(signals, spectral.periodogram(F.col("x"), 128, 128.0))["sine"]
    assert int(np.argmax(p)) == 10
    assert sum(p) == pytest.approx(0.5, rel=0.01)  # the sine's power
    f, w = kernels.welch(np.sin(2 * np.pi * 10 * np.arange(128) / 128)[None], 128.0, 128)
    assert w[0] == pytest.approx(np.array(p), abs=1e-12)


def test_long_epochs_use_the_kernel(spark):
    t = np.arange(512) / 256
    df = spark.createDataFrame([(1, np.sin(2 * np.pi * 10 * t).tolist())], "id long, x array<double>")
    r = generate_features(df, ["id"], 256.0, 512, FeatureSpec(families=("psd",))).first()
    assert r["Alpha_PSD"] > 0.95 and r["ThetaAlpha_PSD"] > 0.5 and r["Beta2_PSD"] < 0.01


def test_features_follow_the_spec(signals):
    out = generate_features(signals, ["name"], 128.0, 128, FeatureSpec(families=("acw",)))
    assert out.columns == ["name", "ACW"]
    with pytest.raises(ValueError):
        FeatureSpec(families=("nope",))


def test_complexity_of_simple_signals(signals):
    assert value(signals, nonlinear.permutation_entropy(F.col("x")))["ramp"] == 0
    assert value(signals, nonlinear.petrosian_fd(F.col("x")))["ramp"] == 1
    katz = value(signals, nonlinear.katz_fd(F.col("x")))
    assert katz["ramp"] == pytest.approx(1) and katz["flat"] == 0
    pe = value(signals, nonlinear.permutation_entropy(F.col("x")))["noise"]
    assert pe > 0.95
    assert value(signals, nonlinear.higuchi_fd(F.col("x")))["noise"] > 1.8


def test_acw(signals):
    v = value(signals, nonlinear.acw(F.col("x"), 128.0))
    assert v["noise"] == pytest.approx(1 / 128) and v["flat"] == 1.0
    assert 1 / 128 < v["sine"] < 6 / 128


def test_simpson_is_exact_for_cubics(spark):
    for n in (2, 3, 4, 5, 8, 9):
        x = np.arange(n, dtype=float)
        y = x**2
        df = spark.createDataFrame([(y.tolist(),)], "y array<double>")
        got = df.select(arrays.simpson(F.col("y"))).first()[0]
        want = (n - 1) ** 3 / 3
        assert got == pytest.approx(want if n > 2 else 0.5)


def test_svd_entropy_matches_numpy(signals):
    x = np.array(signals.where("name = 'noise'").first()["x"])
    s = np.linalg.svd(np.stack([x[:-2], x[1:-1], x[2:]], axis=1), compute_uv=False)
    s = s / s.sum()
    assert value(signals, nonlinear.svd_entropy(F.col("x")))["noise"] == pytest.approx(-(s * np.log2(s)).sum() / np.log2(3))


def test_dfa_of_noise_and_its_walk(spark):
    r = np.random.default_rng(1).normal(size=4000)
    rows = [("noise", i, float(v)) for i, v in enumerate(r)] + [("walk", i, float(v)) for i, v in enumerate(np.cumsum(r))]
    df = spark.createDataFrame(rows, "chan string, i long, x double")
    a = {r["chan"]: r["alpha"] for r in series.dfa(df, ["chan"]).collect()}
    assert a["noise"] == pytest.approx(0.5, abs=0.1) and a["walk"] == pytest.approx(1.5, abs=0.15)


def test_plateaus_are_one_extremum(spark):
    x = [0, 1, 2, 2, 2, 1, 0, -1, -1, 0, 3]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "chan string, i long, x double")
    got = [(r["i"], r["kind"]) for r in series.local_extrema(df, ["chan"]).orderBy("i").collect()]
    assert got == [(3, "peak"), (7, "trough")]


def test_kernels_on_known_signals():
    t = np.arange(1024) / 256
    x = np.sin(2 * np.pi * 10 * t)[None]
    inside = kernels.band_pass(x, 256.0, 8, 12)[0][200:-200]
    assert np.abs(inside - x[0][200:-200]).max() < 0.05
    assert np.abs(kernels.band_pass(x, 256.0, 20, 40)[0][200:-200]).max() < 0.02
    assert kernels.envelope(x, 256.0, 8, 12)[0][200:-200] == pytest.approx(1, abs=0.1)
    up = kernels.resample(x, 3, 2)
    assert up.shape[1] == 1536
    want = np.sin(2 * np.pi * 10 * np.arange(1536) / 384)
    assert np.abs(up[0][100:-100] - want[100:-100]).max() < 0.01
    assert kernels.lempel_ziv(np.zeros(64)) == 2
    assert kernels.lempel_ziv_normalised(np.random.default_rng(0).normal(size=(1, 4000)))[0] == pytest.approx(1, abs=0.15)
    assert kernels.sample_entropy(np.sin(np.arange(300) / 5)[None])[0] < kernels.sample_entropy(np.random.default_rng(0).normal(size=(1, 300)))[0]


def test_peaks_on_a_line():
    f = np.arange(1, 41.0)
    p = 10 ** (1 - 1.2 * np.log10(f) + 0.8 * np.exp(-((f - 10) ** 2) / (2 * 1.5**2)))
    got = kernels.peaks_and_slope(p[None], f)
    assert got["cf_0"][0] == pytest.approx(10, abs=1) and got["exponent"][0] == pytest.approx(1.2, abs=0.1)
    assert got["cf_1"][0] == 0 or got["pw_1"][0] < 0.3


def test_irasa_finds_the_slope():
    r = np.random.default_rng(0)
    n = 8192
    f = np.fft.rfftfreq(n, 1 / 256)
    spectrum = (r.normal(size=len(f)) + 1j * r.normal(size=len(f))) * np.maximum(f, 0.1) ** -0.75
    x = np.fft.irfft(spectrum, n)[None]
    assert kernels.irasa(x, 256.0, 1024, 2.0, 40.0)["slope"][0] == pytest.approx(-1.5, abs=0.25)


def test_map_epochs_keeps_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, []), (4, [1.0, 1.0])], "id long, x array<double>")
    got = {r["id"]: r["m"] for r in kernels.map_epochs(df, ["id"], lambda x: {"m": x.mean(axis=1)}, "m double").collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: 1.0}


def test_wavelet_power_peaks_at_the_tone():
    x = np.sin(2 * np.pi * 10 * np.arange(512) / 128)[None]
    p = kernels.morlet_power(x, 128.0, [5.0, 10.0, 20.0])[0]
    assert p.argmax() == 1 and p[1] > 20 * max(p[0], p[2])


def test_r_peaks():
    t = np.arange(2560) / 256
    beats = np.arange(0.5, 10, 0.8)
    x = sum(np.exp(-((t - b) ** 2) / (2 * 0.012**2)) for b in beats) + 0.02 * np.random.default_rng(0).normal(size=len(t))
    for sign in (1, -1):
        found = kernels.r_peaks(sign * x[None], 256.0)[0] / 256
        assert len(found) == len(beats) and np.abs(found - beats).max() < 0.02


def test_effort_to_compress():
    assert kernels.pair_substitutions(np.array([1, 1, 1, 1])) == 0
    assert kernels.pair_substitutions(np.array([0, 1, 0, 1, 0, 1])) == 1
    assert kernels.pair_substitutions(np.random.default_rng(0).integers(0, 2, 40)) > 5


def test_frames(spark):
    from signalspark.operators import frames

    df = spark.createDataFrame([("r", "a", 0, 1.0), ("r", "a", 1, 3.0), ("r", "b", 0, 5.0)], "rec string, chan string, t int, x double")
    got = {(r["chan"], r["t"]): r["y"] for r in frames.waveform_frame(df, ["rec"], "chan", 10.0).collect()}
    assert got == {("a", 0): 9.0, ("a", 1): 11.0, ("b", 0): 0.0}
    stages = spark.createDataFrame([(0,), (4,), (3,), (9,)], "code int")
    assert [r["level"] for r in frames.hypnogram_frame(stages).collect()] == [5, 4, 1, 0]
    p = spark.createDataFrame([("Cz", 0.0, 0.0, 1.0), ("Fpz", 0.0, 1.0, 0.0)], "chan string, x double, y double, z double")
    uv = {r["chan"]: (r["u"], r["v"]) for r in frames.scalp_frame(p).collect()}
    assert uv["Cz"] == pytest.approx((0, 0)) and uv["Fpz"] == pytest.approx((0, 1))


def test_further_families(spark, signals):
    """Kernel families come beside the others; null and empty epochs give nulls, gaps of lengths are grouped."""
    spec = FeatureSpec(families=("psd", "complexity", "parameterised", "irasa", "canonical"))
    rows = signals.select("name", "x").union(spark.createDataFrame([("none", None), ("empty", [])], "name string, x array<double>"))
    out = {r["name"]: r for r in generate_features(rows, ["name"], 128.0, 128, spec).collect()}
    assert out["none"]["DFA"] is None and out["empty"]["SampleEntropy"] is None and out["none"]["Alpha_PSD"] is None
    assert 0.3 < out["noise"]["DFA"] < 0.8 and out["noise"]["LempelZiv"] > out["sine"]["LempelZiv"]


def test_fluctuation_of_a_walk():
    walk = np.cumsum(np.random.default_rng(1).normal(size=(4, 4000)), axis=1)
    assert kernels.epoch_dfa(walk) == pytest.approx(1.5, abs=0.15)
    assert kernels.epoch_dfa(np.diff(walk)) == pytest.approx(0.55, abs=0.12)
    assert np.isnan(kernels.epoch_dfa(np.zeros((1, 20)))).all()
