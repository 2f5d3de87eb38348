import numpy as np
import pytest

from signalspark.operators import connectivity as cn
from signalspark.operators import stats


def test_wavelets_tell_locked_channels_from_others(spark):
    r = np.random.default_rng(0)
    t = np.arange(640) / 128
    phase = np.cumsum(r.normal(0, 0.05, 640))
    locked = {0: np.sin(2 * np.pi * 10 * t + phase), 1: np.sin(2 * np.pi * 10 * t + phase + 1.0), 2: r.normal(size=640)}
    rows = [("e", c, [float(v) for v in x]) for c, x in locked.items()] + [("e", 3, None), ("f", 0, [1.0, 2.0, 3.0]), ("f", 1, [0.5, None])]
    bands = spark.createDataFrame([("Alpha", 8.0, 12.0), ("None", 90.0, 99.0)], "band string, fmin double, fmax double")
    out = cn.wavelet_connectivity(spark.createDataFrame(rows, "rec string, chan int, x array<double>"), ["rec"], "chan", 128.0, bands, 4.0, 40.0).collect()
    got = {(g["rec"], g["a"], g["b"]): g for g in out}
    assert set(got) == {("e", 0, 1), ("e", 0, 2), ("e", 1, 2), ("f", 0, 1)} and {g["band"] for g in out} == {"Alpha"}
    for m in ("coh", "plv", "ciplv", "pli", "wpli"):
        assert got["e", 0, 1][m] > 0.9 and got["e", 0, 2][m] < got["e", 0, 1][m]


def test_coefficients_equal_direct_convolution(spark):
    x = np.random.default_rng(1).normal(size=100)
    df = spark.createDataFrame([(1, 0, [float(v) for v in x])], "e int, chan int, x array<double>")
    freqs = cn.log_frequencies(4.0, 20.0, 3)
    row = cn.wavelet_coefficients(df, ["e"], "chan", 64.0, freqs, cn.growing_cycles(20.0, 3), decim=3).first()
    want = []
    for f, c in zip(freqs, cn.growing_cycles(20.0, 3), strict=True):
        w = np.array(cn.morlet_weights(f, 64.0, c))
        want.append(np.convolve(x, w)[len(w) // 2 : len(w) // 2 + 100 : 3])
    got = np.array(row["re"]) + 1j * np.array(row["im"])
    assert np.abs(got - np.concatenate(want)).max() < 1e-12


def test_labels_in_order_over_ranges(spark):
    values = [f"v{k * 7 % 500:03d}" for k in range(500)] * 2 + [None]
    got = {r["v"]: r["code"] for r in stats.label_encode(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert got.pop(None) is None
    assert [got[v] for v in sorted(got)] == list(range(500))
