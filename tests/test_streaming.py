from datetime import datetime, timedelta

import numpy as np
import pytest

from signalspark.streaming import features

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema, name):
        path = str(tmp_path / name)
        for k in range(2):  # two batches
            spark.createDataFrame(rows[k::2] if name == "mixed" else rows[k * len(rows) // 2 : (k + 1) * len(rows) // 2], schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.schema(schema).parquet(path)

    return make


def run(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


SAMPLES = "chan string, ts timestamp, x double"


def samples(n=200):
    return [("a" if i % 2 else "b", T0 + timedelta(milliseconds=100 * i), float(np.sin(i / 3))) for i in range(n)]


def test_windows_equal_the_batch_result(spark, stream):
    s, b = stream(samples(), SAMPLES, "s1")
    got = run(features.sliding_stats(s, ["chan"], "4 seconds", "2 seconds", "1 second"), "w1", spark, "complete")
    want = features.sliding_stats(b, ["chan"], "4 seconds", "2 seconds", "1 second")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_epochs_are_ordered(spark, stream):
    s, _ = stream(samples(), SAMPLES, "mixed")
    got = run(features.sliding_epochs(s, ["chan"], "2 seconds", "2 seconds", "30 seconds"), "w2", spark, "complete").where("chan = 'a'").orderBy("start").first()
    assert got["x"] == pytest.approx([np.sin(i / 3) for i in range(1, 20, 2)])


def test_interval_join(spark, stream):
    s, b = stream(samples(), SAMPLES, "s3")
    m = [("a", T0 + timedelta(seconds=k), k) for k in range(2, 18, 4)]
    ms, mb = stream(m, "chan string, ts timestamp, code long", "m3")
    got = run(features.locked_samples(s, ms, ["chan"], "1 second", "1 second", "60 seconds"), "w3", spark)
    want = features.locked_samples(b, mb, ["chan"], "1 second", "1 second", "60 seconds")
    assert got.count() == want.count() == sum(1 for i in range(200) if i % 2 for _, t, _ in m if abs((T0 + timedelta(milliseconds=100 * i) - t).total_seconds()) <= 1)


def test_filter_state_goes_on_between_batches(spark, stream):
    s, _ = stream(samples(), SAMPLES, "s4")
    got = run(features.filtered(s, "chan", ([0.2], [1.0, -0.8])), "w4", spark)
    y, want = 0.0, []
    for i in range(1, 200, 2):
        y = 0.2 * np.sin(i / 3) + 0.8 * y
        want.append(y)
    assert [r["y"] for r in got.where("chan = 'a'").orderBy("ts").collect()] == pytest.approx(want)


def test_closed_loop(spark, stream, tmp_path):
    s, _ = stream(samples(), SAMPLES, "s5")
    seen = []
    q = features.closed_loop(s, seen.append, "x", str(tmp_path / "c"), 0.5)
    q.processAllAvailable()
    q.stop()
    assert seen and all(r["error"] == pytest.approx(r["mean"] - 0.5) for r in seen)


def test_trail_is_smoothed_over_batches(spark, stream):
    s, _ = stream(samples(), SAMPLES, "s6")
    got = run(features.smoothed_trail(s, "chan", 4), "w6", spark)
    x = [np.sin(i / 3) for i in range(1, 200, 2)]
    want = [np.mean(x[max(0, k - 3) : k + 1]) for k in range(len(x))]
    assert [r["y"] for r in got.where("chan = 'a'").orderBy("ts").collect()] == pytest.approx(want)


def test_running_average_equals_the_batch_result(spark, stream):
    rows = [("a", T0 + timedelta(milliseconds=250 * i), T0 + timedelta(seconds=i // 8 * 2), float(i)) for i in range(64)]
    s, b = stream(rows, "chan string, ts timestamp, onset timestamp, x double", "s7")
    got = run(features.running_average(s, ["chan"], 0.5), "w7", spark, "complete")
    want = features.running_average(b, ["chan"], 0.5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 4
