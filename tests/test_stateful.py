"""Streams with state give what batches give, however they are cut and across restarts."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import subspace
from signalspark.operators.timeline import range_scan
from signalspark.plans.features import generate_features
from signalspark.schema import FeatureSpec
from signalspark.streaming import stateful

T0 = datetime(2024, 1, 1)
FRAMES = "rec string, t long, ts timestamp, x array<double>"
N, WINDOW, STEP, AHEAD = 4, 40, 16, 20


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def feed(spark, path, rows, schema, cuts):
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)


def replay(spark, df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def recording(gap=True):
    r = np.random.default_rng(4)
    x = r.normal(size=(N, N)) @ r.normal(size=(N, 600))
    x[:, 250:300] += 40 * r.normal(size=(N, 1)) * np.sin(np.arange(50) / 2)
    times = [t for t in range(600) if not gap or not 400 <= t < 420]
    return x, times


def long_rows(spark, x, times):
    return spark.createDataFrame([("a", c, t, float(x[c, t])) for t in times for c in range(N)], "rec string, chan int, t long, x double")


def frame_rows(x, times):
    return [("a", t, T0 + timedelta(milliseconds=10 * t), [float(v) for v in x[:, t]]) for t in times]


@pytest.fixture(scope="module")
def model(spark):
    x, times = recording(False)
    keep = [t for t in times if not 250 <= t < 300]
    return subspace.subspace_model(long_rows(spark, x, keep), ["rec"], 20, 4.0).cache()


def batch_clean(spark, model, segment):
    x, times = recording()
    out = subspace.subspace_clean(long_rows(spark, x, times), model, ["rec"], WINDOW, STEP, AHEAD, segment).collect()
    return {(r["chan"], r["t"]): r["x"] for r in out}


def test_segments_equal_one_pass(spark, model):
    x, times = recording()
    m = model.first()
    filled = np.where(np.isin(np.arange(600), times), x, 0.0)
    c = subspace.Cleaner(np.array(m["mixing"]).reshape(N, N), np.array(m["limits"]).reshape(N, N), WINDOW, STEP, AHEAD)
    want = np.concatenate([y for _, y in c.push(filled) + c.flush()], axis=1)
    for segment in (48, 112, 1 << 16):
        got = batch_clean(spark, model, segment)
        assert set(got) == {(k, t) for k in range(N) for t in times}
        assert max(abs(got[k, t] - want[k, t]) for k, t in got) < 1e-9
    assert np.abs(want[:, 255:295]).max() < 0.5 * np.abs(x[:, 255:295]).max()
    assert np.abs(want[:, :200] - x[:, :200]).max() < 1e-9


@pytest.mark.parametrize("cuts", [[300], [7, 11, 250, 263, 410, 411, 500]])
def test_cleaned_stream_equals_the_batch_and_survives_a_restart(spark, model, tmp_path, cuts):
    x, times = recording()
    rows = frame_rows(x, times)
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))

    def start():
        replay(spark, stateful.clean_stream(source(spark, src, FRAMES), model, "rec", WINDOW, STEP, AHEAD, "1 second", silence_ms=2000), out, check)

    half = cuts[: len(cuts) // 2 + 1]
    feed(spark, src, rows[: half[-1]], FRAMES, half[:-1])
    start()
    feed(spark, src, rows[half[-1] :], FRAMES, [c - half[-1] for c in cuts[len(half) :]])
    start()  # from the checkpoint
    want = batch_clean(spark, model, 64)
    got = {r["t"]: r for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count()
    decided = {t for t in times if t < 600 // STEP * STEP - AHEAD}
    assert set(got) == decided
    assert max(abs(got[t]["x"][c] - want[c, t]) for t in got for c in range(N)) < 1e-9
    assert all(got[t]["ts"] == T0 + timedelta(milliseconds=10 * t) for t in got)
    # Another recording moves the time on: what waited is told. It has no model and passes.
    feed(spark, src, [("b", k, T0 + timedelta(seconds=60 + k), [1.0] * N) for k in range(3)], FRAMES, [])
    start()
    feed(spark, src, [("b", k, T0 + timedelta(seconds=60 + k), [1.0] * N) for k in range(3, 5)], FRAMES, [])
    start()
    got = {r["t"]: r for r in spark.read.parquet(out).where("rec = 'a'").collect()}
    assert set(got) == set(times)
    assert max(abs(got[t]["x"][c] - want[c, t]) for t in got for c in range(N)) < 1e-9
    assert spark.read.parquet(out).where("rec = 'b'").count() == 5


def test_model_counts_every_block_and_absent_channels(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3, 3)) @ r.normal(size=(3, 3000 * 4))
    rows = [(t // 4, c, t, float(x[c, t])) for t in range(x.shape[1]) for c in range(3) if not (c == 2 and t < 400)]
    df = spark.createDataFrame(rows, "b long, chan int, t long, x double").withColumn("rec", F.lit("r"))
    got = subspace.subspace_model(df, ["rec"], 4, 3.0).first()
    x[2, :400] = 0
    covs = np.stack([(b @ b.T / 4).ravel() for b in np.split(x, 3000, axis=1)])
    from signalspark.operators.multichannel import geometric_median

    centre = geometric_median(covs).reshape(3, 3)
    mixing = np.array(got["mixing"]).reshape(3, 3)
    assert np.abs(mixing @ mixing - centre).max() < 1e-3 * np.abs(centre).max()
    v = np.linalg.eigh(centre)[1]
    amp = np.sqrt(np.einsum("bij,ik,jk->bk", covs.reshape(-1, 3, 3), v, v))
    limits = np.median(amp, axis=0) + 3 * (np.quantile(amp, 0.75, axis=0) - np.quantile(amp, 0.25, axis=0)) / 1.35
    assert np.sqrt((np.array(got["limits"]).reshape(3, 3) ** 2).sum(axis=1)) == pytest.approx(limits, rel=5e-3)
    assert got["chans"] == ["0", "1", "2"]


def test_ring_buffer_equals_range_scans(spark, tmp_path):
    schema = "chan string, ts timestamp, x double"
    rate, step = 10.0, timedelta(milliseconds=100)
    rows = [("a", T0 + k * step, float(k)) for k in range(100) if not 30 <= k < 55] + [("b", T0 + k * step, float(-k)) for k in range(40)]
    rows = sorted(rows, key=lambda r: r[1]) + [("z", T0 + timedelta(seconds=40), 0.0), ("z", T0 + timedelta(seconds=41), 0.0)]
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    feed(spark, src, rows, schema, [33, 60, 90, len(rows) - 2, len(rows) - 1])
    ring = stateful.ring_buffer(source(spark, src, schema), "chan", rate, "2 seconds", "1 second", "1 second", patience="3 seconds", default=-99.0)
    replay(spark, ring, out, check)
    got = {(r["chan"], (r["ts"] - T0).total_seconds()): r["x"] for r in spark.read.parquet(out).where("chan <> 'z'").collect()}
    # b falls silent at 4 s: its windows go on for the patience.
    assert sorted(t for c, t in got if c == "b") == [1, 2, 3, 4, 5, 6, 7]
    assert got["b", 6.0] == [-99.0] * 20 and got["b", 5.0][:10] == [-float(k) for k in range(30, 40)] and got["b", 5.0][10:] == [-99.0] * 10
    assert sorted(t for c, t in got if c == "a") == list(range(1, 14))
    samples = spark.createDataFrame([("a", 0, k, float(k)) for k in range(30)] + [("a", 1, k - 55, float(k)) for k in range(55, 100)], "chan string, seq int, k long, x double")
    seqs = spark.createDataFrame([("a", 0, 0.0, 30), ("a", 1, 5.5, 45)], "chan string, seq int, start double, n long")
    for tick in (2, 3, 4, 5, 6, 7, 9):
        want = range_scan(samples, seqs, ["chan"], rate, tick - 2.0, float(tick), default=-99.0).orderBy("i").collect()
        assert got["a", float(tick)] == [r["x"] for r in want]


def test_rows_that_are_too_late_are_left_out(spark, tmp_path):
    schema = "chan string, ts timestamp, x double"
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    at = lambda s: T0 + timedelta(seconds=s)
    feed(spark, src, [("a", at(0), 1.0), ("a", at(5), 2.0), ("a", at(6), 3.0), ("a", at(1), 7.0), ("a", at(12), 4.0), ("a", at(13), 4.0)], schema, [2, 3, 4, 5])
    replay(spark, stateful.ring_buffer(source(spark, src, schema), "chan", 1.0, "4 seconds", "4 seconds", "1 second", default=0.0), out, check)
    got = {(r["ts"] - T0).total_seconds(): r["x"] for r in spark.read.parquet(out).collect()}
    assert got[4.0] == [1.0, 0.0, 0.0, 0.0] and got[8.0] == [0.0, 2.0, 3.0, 0.0]


def test_feature_stream_equals_the_batch(spark, tmp_path):
    r = np.random.default_rng(1)
    rate, n = 32.0, 32 * 12
    x = r.normal(size=(n, 2))
    rows = [("a", k, T0 + timedelta(seconds=k / rate), [float(v) for v in x[k]]) for k in range(n)]
    rows += [("z", 0, T0 + timedelta(seconds=100), [0.0, 0.0]), ("z", 1, T0 + timedelta(seconds=101), [0.0, 0.0])]
    b = np.hanning(9) / np.hanning(9).sum()
    src, out, check = (str(tmp_path / k) for k in ("src", "out", "check"))
    feed(spark, src, rows, FRAMES, [100, 101, 250, n, n + 1])
    spec = FeatureSpec(families=("psd", "acw", "hjorth"))
    features = stateful.feature_stream(source(spark, src, FRAMES), "rec", (b.tolist(), [1.0]), "4 seconds", "2 seconds", "1 second", rate, spec)
    replay(spark, features, out, check)
    y = np.convolve(x.mean(axis=1), b)[:n]
    epochs = [("a", T0 + timedelta(seconds=2 * k), y[64 * k : 64 * k + 128].tolist()) for k in range(5)]
    want = generate_features(spark.createDataFrame(epochs, "rec string, start timestamp, x array<double>"), ["rec", "start"], rate, 128, spec)
    got = sorted(spark.read.parquet(out).where("rec = 'a'").collect(), key=lambda r: r["start"])
    for g, w in zip(got, sorted(want.collect(), key=lambda r: r["start"]), strict=True):
        assert g["start"] == w["start"]
        assert [g[c] for c in want.columns[2:]] == pytest.approx([w[c] for c in want.columns[2:]])


def test_labelled_trials(spark, tmp_path):
    rate = 16.0
    r = np.random.default_rng(2)
    x = r.normal(size=(16 * 20, 2))
    rows = [("a", k, T0 + timedelta(seconds=k / rate), [float(v) for v in x[k]]) for k in range(len(x)) if k != 200]
    rows.append(("z", 0, T0 + timedelta(seconds=60), [0.0, 0.0]))
    marks = [("a", T0 + timedelta(seconds=s), c) for s, c in ((2, "left"), (7, "right"), (8.5, "left"), (11, "right"))]
    marks.append(("z", T0 + timedelta(seconds=60), "none"))
    src, msrc, out, check = (str(tmp_path / k) for k in ("src", "marks", "out", "check"))
    feed(spark, src, rows, FRAMES, [80, 180, len(rows) - 1])
    feed(spark, msrc, marks, "rec string, ts timestamp, condition string", [1, 3, 4])
    spec = FeatureSpec(families=("psd", "hjorth"))
    made = stateful.labelled_features(source(spark, src, FRAMES), source(spark, msrc, "rec string, ts timestamp, condition string"), "rec", rate, "2 seconds", "1 second", "6 seconds", spec)
    replay(spark, made, out, check)
    feed(spark, src, [("z", 1, T0 + timedelta(seconds=61), [0.0, 0.0])], FRAMES, [])
    feed(spark, msrc, [("z", T0 + timedelta(seconds=61), "none")], "rec string, ts timestamp, condition string", [])
    replay(spark, made, out, check)
    want = []
    for _, ts, condition in marks[:-1]:
        for e in range(2):
            a = int(((ts - T0).total_seconds() + e) * rate)
            if not a <= 200 < a + 16:
                want += [("a", ts, condition, e, c, x[a : a + 16, c].tolist()) for c in range(2)]
    keys = ["rec", "onset", "condition", "epoch", "chan"]
    want = generate_features(spark.createDataFrame(want, "rec string, onset timestamp, condition string, epoch long, chan int, x array<double>"), keys, rate, 16, spec)
    order = lambda r: tuple(r[k] for k in keys)
    got = sorted(spark.read.parquet(out).where("rec = 'a'").collect(), key=order)
    want = sorted(want.collect(), key=order)
    assert [order(g) for g in got] == [order(w) for w in want] and len(got) == 14
    for g, w in zip(got, want, strict=True):
        assert list(g[5:]) == pytest.approx(list(w[5:]))
