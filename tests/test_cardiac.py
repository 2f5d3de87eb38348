import numpy as np
import pytest

from signalspark.operators import cardiac


def test_a_rhythm_is_the_peak_of_the_periodogram(spark):
    t, rr = 0.0, []
    for _ in range(400):
        x = 800 + 40 * np.sin(2 * np.pi * 0.25 * t)
        t += x / 1000
        rr.append(x)
    rows = [("a", i, float(x)) for i, x in enumerate(rr)] + [("b", i, 700.0) for i in range(3)] + [("a", 400, None)]
    got = cardiac.hrv_frequency(spark.createDataFrame(rows, "rec string, i long, rr double"), ["rec"], ["i"]).collect()
    assert [g["rec"] for g in got] == ["a"]
    assert got[0]["peak"] == pytest.approx(0.25, abs=0.006) and got[0]["hf"] > 20 * got[0]["lf"]


def test_recurrence_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.round(np.cumsum(r.normal(size=150)), 3)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0), ("c", 0, None)]
    out = {g["rec"]: g for g in cardiac.recurrence(spark.createDataFrame(rows, "rec string, i long, rr double"), ["rec"], ["i"], 0.8, dimension=3, delay=2, least=3).collect()}
    v = np.stack([x[: 150 - 4], x[2 : 150 - 2], x[4:]], axis=1)
    near = np.abs(v[:, None] - v[None]).max(axis=2) <= 0.8
    lines = []
    for k in range(1, len(v)):
        for run in "".join("1" if b else "0" for b in np.diagonal(near, k)).split("0"):
            lines += [len(run)] if run else []
    long = np.array([n for n in lines if n >= 3])
    share = np.bincount(long)[np.bincount(long) > 0] / len(long)
    g = out["a"]
    assert set(out) == {"a"} and g["n"] == len(v)
    assert g["recurrence_rate"] == pytest.approx(sum(lines) / (len(v) * (len(v) - 1) / 2))
    assert g["determinism"] == pytest.approx(long.sum() / sum(lines)) and g["mean_line"] == pytest.approx(long.mean())
    assert g["longest_line"] == long.max() and g["line_entropy"] == pytest.approx(-(share * np.log(share)).sum())
