import numpy as np
import pytest

from signalspark.operators import filters, spatial
from signalspark.plans.cleaning import clean


def montage(n=16):
    z = np.linspace(0.95, -0.4, n)
    a = np.arange(n) * np.pi * (3 - np.sqrt(5))
    r = np.sqrt(1 - z**2)
    return {f"E{k:02d}": (float(r[k] * np.cos(a[k])), float(r[k] * np.sin(a[k])), float(z[k])) for k in range(n)}


def field(pos, samples, seed=0):
    r = np.random.default_rng(seed)
    p = np.array([pos[c] for c in sorted(pos)])
    return p @ r.normal(size=(3, samples)) + 0.5 * r.normal(size=samples) + 0.05 * r.normal(size=(len(p), samples))


def frame(spark, pos, x, rec="r", skip=()):
    rows = [(rec, c, t, float(x[i, t])) for i, c in enumerate(sorted(pos)) for t in range(x.shape[1]) if (c, t) not in skip]
    return spark.createDataFrame(rows, "rec string, chan string, t long, x double")


def test_splines_go_through_their_sources_and_keep_constants():
    pos = np.array(list(montage().values()))
    assert np.abs(spatial.spline_weights(pos, pos, ridge=1e-12) - np.eye(len(pos))).max() < 1e-6
    w = spatial.spline_weights(3.0 * pos[::2], pos)
    assert np.abs(w.sum(axis=1) - 1).max() < 1e-9
    assert np.abs(w @ pos[::2] - pos)[1::2].mean() < 0.1  # a smooth field comes back
    x = np.linspace(-1, 1, 9)
    want = sum((2 * n + 1) / (n * (n + 1.0)) ** 4 * np.polynomial.legendre.legval(x, [0] * n + [1]) for n in range(1, 51)) / (4 * np.pi)
    assert np.abs(spatial._green(x, 4, 50) - want).max() < 1e-12


def slow_correlations(pos, cells, size, share, count, seed):
    """Sample by sample, from the table of weights."""
    chans, by = sorted(pos), {}
    for k, target, chan, w in spatial.subset_weights(pos, share, count, seed):
        by.setdefault((k, target), []).append((chan, w))
    out = {}
    for window in {t // size for _, t in cells}:
        times = sorted({t for _, t in cells if t // size == window})
        full = {c for c in chans if all((c, t) in cells for t in times)}
        for target in full:
            use = [v for (k, to), v in by.items() if to == target and all(c in full for c, _ in v)]
            if use:
                p = [np.median([sum(w * cells[c, t] for c, w in v) for v in use]) for t in times]
                out[window, target] = np.corrcoef(p, [cells[target, t] for t in times])[0, 1]
            else:
                out[window, target] = None
    return out


def test_a_planted_bad_channel_is_found_as_by_brute_force(spark):
    pos = montage()
    x = field(pos, 300)
    x[5] = np.random.default_rng(9).normal(size=300)
    lost = {("E03", t) for t in range(64, 128)} | {("E07", 290)}
    df = frame(spark, pos, x, skip=lost).unionByName(spark.createDataFrame([("r", "ear", 0, 1.0), ("r", None, 0, 1.0), ("r", "E01", 64, None)], "rec string, chan string, t long, x double").where("chan <> 'E01' or chan is null"))
    got = {(r["window"], r["chan"]): r["r"] for r in spatial.prediction_correlations(df, ["rec"], pos, 64, count=20, per_task=2).collect()}
    cells = {(c, t): x[i, t] for i, c in enumerate(sorted(pos)) for t in range(300) if (c, t) not in lost}
    want = slow_correlations(pos, cells, 64, 0.25, 20, 0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    votes = spatial.unpredicted_channels(df, ["rec"], pos, 64, count=20).collect()
    assert [r["chan"] for r in votes if r["bad"]] == ["E05"]
    assert {r["chan"]: r["windows"] for r in votes}["E03"] == 4


def test_channels_alone_constant_or_absent(spark):
    pos = montage(4)
    flat = [("r", c, t, 1.0) for c in sorted(pos) for t in range(8)]
    got = spatial.unpredicted_channels(spark.createDataFrame(flat, "rec string, chan string, t long, x double"), ["rec"], pos, 4).collect()
    assert len(got) == 4 and all(r["bad"] and r["mean_r"] is None for r in got)
    one = spark.createDataFrame([r for r in flat if r[1] == "E00"], "rec string, chan string, t long, x double")
    assert [(r["chan"], r["low"]) for r in spatial.unpredicted_channels(one, ["rec"], pos, 4).collect()] == [("E00", 2)]
    assert spatial.unpredicted_channels(one.limit(0), ["rec"], pos, 4).count() == spatial.fill_channels(one.limit(0), ["rec"], pos, 4).count() == 0


def test_filled_channels_are_splines_of_the_others(spark):
    pos = montage()
    x = field(pos, 100)
    lost = {("E04", t) for t in range(100)} | {("E09", t) for t in range(40, 100)}
    df = frame(spark, pos, x, skip=lost)
    got = {(r["chan"], r["t"]): r["x"] for r in spatial.fill_channels(df, ["rec"], pos, 50).collect()}
    chans, p = sorted(pos), np.array([pos[c] for c in sorted(pos)])
    assert len(got) == 16 * 100 - 10  # E09 has some times of the first segment, which stays as it is
    for seg, lack in ((0, [4, 9]), (1, [4, 9])):
        have = [i for i in range(16) if i not in lack]
        want = spatial.spline_weights(p[have], p[lack]) @ x[have]
        for t in range(50 * seg, 50 * seg + 50):
            assert got["E04", t] == pytest.approx(want[0, t], abs=1e-9)
            assert ("E09", t) not in got if 40 <= t < 50 else got["E09", t] == pytest.approx(x[9, t] if t < 40 else want[1, t], abs=1e-9)
    assert all(got[c, t] == x[i, t] for i, c in enumerate(chans) for t in range(100) if (c, t) not in lost)


@pytest.mark.parametrize("segment", [70, 100, 4096])
def test_filter_in_segments_equals_one_pass(spark, segment):
    x = np.random.default_rng(2).normal(size=500)
    taps = filters.band_taps(64.0, 4.0, 12.0)
    df = spark.createDataFrame([("a", t, float(v) if t != 33 else None) for t, v in enumerate(x) if not 200 <= t < 260] + [("b", 7, 1.0)], "chan string, t long, x double")
    got = {(r["chan"], r["t"]): r["x"] for r in filters.fir_centred(df, ["chan"], taps, segment).collect()}
    x[200:260] = x[33] = 0
    want = np.convolve(x, taps)[len(taps) // 2 :]
    assert len(got) == 441 and got["b", 7] == pytest.approx(taps[len(taps) // 2])
    assert max(abs(got["a", t] - want[t]) for c, t in got if c == "a") < 1e-12


def test_designs_keep_and_stop_what_they_say():
    def gain(taps, f, srate):
        n = np.arange(len(taps))
        return abs((taps * np.exp(-2j * np.pi * f / srate * n)).sum())

    b = filters.band_taps(256.0, 1.0, 40.0)
    assert all(gain(b, f, 256) == pytest.approx(1, abs=0.01) for f in (2, 10, 40)) and gain(b, 0, 256) < 1e-9 and gain(b, 60, 256) < 0.01
    assert gain(filters.band_taps(256.0, None, 30.0), 0, 256) == pytest.approx(1)
    n = filters.notch_taps(256.0, 50.0)
    assert gain(n, 50, 256) < 0.02 and all(gain(n, f, 256) == pytest.approx(1, abs=0.01) for f in (0, 48, 52, 100))
    for wrong in ((None, None), (20.0, 10.0), (1.0, 200.0), (0.0, 10.0)):
        with pytest.raises(ValueError):
            filters.band_taps(256.0, *wrong)


def test_steps_of_the_cleaning_list(spark):
    pos = montage()
    t = np.arange(512) / 64
    x = field(pos, 512) * np.sin(2 * np.pi * 8 * t) + 3 * np.sin(2 * np.pi * 25 * t)
    x[2] = 10 * np.random.default_rng(1).normal(size=512)
    steps = [("band", {"srate": 64.0, "low": 2.0, "high": 14.0}), ("drop_unpredicted", {"positions": pos, "size": 64, "count": 20}), ("fill_channels", {"positions": pos}), ("reference", {})]
    got = clean(frame(spark, pos, x), ["rec"], steps).toPandas().pivot(index="chan", columns="t", values="x")
    assert list(got.index) == sorted(pos) and got.shape == (16, 512)
    assert np.abs(got.to_numpy().mean(axis=0)).max() < 1e-9 and np.abs(got.loc["E02"]).max() < 8
