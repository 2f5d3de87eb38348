"""Recordings with gaps, windows and distribution functions on small cases."""

import pytest
from pyspark.sql import functions as F

from signalspark.operators import segment, stats, timeline


@pytest.fixture(scope="module")
def recording(spark):
    """Two stretches of three and two samples at 2 Hz, from 10 s and from 20 s."""
    rows = [("r", 0, 0, 1.0), ("r", 0, 1, 2.0), ("r", 0, 2, 3.0), ("r", 1, 0, 4.0), ("r", 1, 1, 5.0)]
    s = spark.createDataFrame(rows, "rec string, seq long, k long, x double")
    starts = spark.createDataFrame([("r", 0, 10.0), ("r", 1, 20.0)], "rec string, seq long, start double")
    return s, timeline.sequences(s, starts, ["rec"])


def test_times_and_places_agree(recording):
    s, q = recording
    there = timeline.sample_times(s, q, ["rec"], 2.0)
    back = timeline.locate(there.select("rec", "t", F.col("index").alias("of")), q, ["rec"], 2.0)
    assert back.where("not (index <=> of)").isEmpty()
    again = timeline.times_of(there.select("rec", "index", F.col("t").alias("of")), q, ["rec"], 2.0)
    assert again.where("not (t <=> of)").isEmpty()


def test_gaps_and_ends_have_no_sample(spark, recording):
    s, q = recording
    at = spark.createDataFrame([("r", t) for t in (9.9, 10.6, 11.5, 19.9, 20.99, 21.0)], "rec string, t double")
    got = timeline.values_at(at, s, q, ["rec"], 2.0, -1.0).orderBy("t")
    assert [r.x for r in got.collect()] == [-1.0, 2.0, -1.0, -1.0, 5.0, -1.0]


def test_range_is_cut_to_the_recording(recording):
    s, q = recording
    got = timeline.range_scan(s, q, ["rec"], 2.0, 9.0, 99.0, 0.0).orderBy("i").collect()
    assert got[0].t == 10.0 and got[-1].t == 20.5 and len(got) == 22
    assert [r.x for r in got if r.x] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_empty_recording(spark, recording):
    s, q = recording
    assert timeline.range_scan(s.where("false"), q.where("false"), ["rec"], 2.0, 0.0, 9.0).isEmpty()
    at = spark.createDataFrame([("r", 1.0)], "rec string, t double")
    assert timeline.values_at(at, s.where("false"), q.where("false"), ["rec"], 2.0, 7.0).first().x == 7.0


def test_token_offsets(spark):
    df = spark.createDataFrame([(1, "ab.ab."), (2, ""), (3, None), (4, "x"), (5, "aaa")], "id int, s string")
    got = timeline.token_offsets(df, ["id"], "s", "b.").orderBy("id", "n").collect()
    assert [(r.id, r.place) for r in got] == [(1, 1), (1, 4)]
    assert [r.place for r in timeline.token_offsets(df, ["id"], "s", "aa").collect()] == [0]


def test_weights_of_both_streams_add_up(spark):
    df = spark.range(70).select(F.lit(1).alias("c"), F.col("id").alias("i"), F.lit(1.0).alias("x"))
    out = segment.overlap_add(segment.half_shift_epochs(df, ["c"], 16), ["c"])
    assert out.count() == 64 and out.where("abs(x - 1) > 1e-12").isEmpty()


def test_windows_list_each_row_as_often_as_it_stands_in_one(spark):
    got = segment.sliding_windows(spark.range(10).withColumnRenamed("id", "i"), 4, 2)
    want = {(i, w) for i in range(10) for w in range(5) if 2 * w <= i < 2 * w + 4}
    assert {(r.i, r.window) for r in got.collect()} == want


def test_distribution_functions(spark):
    """Against table values of Student's t and the normal."""
    rows = [(12.7062, 1), (4.30265, 2), (2.57058, 5), (2.22814, 10), (1.98397, 100), (0.0, 7)]
    p = spark.createDataFrame(rows, "t double, n int").select(stats.student_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    assert [round(r.p, 4) for r in p] == [0.05, 0.05, 0.05, 0.05, 0.05, 1.0]
    q = spark.createDataFrame([(0.975,), (0.5,), (0.001,), (0.0,)], "p double").select(stats.normal_quantile(F.col("p")).alias("q")).collect()
    assert [None if r.q is None else round(r.q, 6) for r in q] == [1.959964, 0.0, -3.090232, None]


def test_event_records(spark):
    """Records as the format lays them out."""
    import struct
    from datetime import datetime

    from signalspark.sources import event_records

    def event(k, name):
        return struct.pack("<HHIddIbxxx", k, 7, 70000, 1.5 * k, 0.25, 9, -1) + name.encode("utf-16-le").ljust(78, b"\0") + b"\0\0"

    rows = [("a", event(1, "SLEEP-S0") + event(2, "apnea")), ("b", b""), ("c", None)]
    got = event_records.event_records(spark.createDataFrame(rows, "rec string, data binary"), ["rec"]).orderBy("n").collect()
    assert [(r.rec, r.n, r.location, r.start, r.creator, r.name) for r in got] == [("a", 0, 1, 1.5, -1, "SLEEP-S0"), ("a", 1, 2, 3.0, -1, "apnea")]
    stamps = struct.pack("<HBBBBBxI", 2020, 2, 29, 23, 59, 58, 123456) + struct.pack("<HBBBBBxI", 2020, 2, 30, 0, 0, 0, 0)
    got = event_records.start_times(spark.createDataFrame([("a", stamps)], "rec string, data binary"), ["rec"]).orderBy("n").collect()
    assert [r.t for r in got] == [datetime(2020, 2, 29, 23, 59, 58, 123456), None]
    with pytest.raises(Exception, match="no whole records"):
        event_records.event_records(spark.createDataFrame([("a", b"123")], "rec string, data binary"), ["rec"]).collect()


def test_cleaning_steps(spark):
    from signalspark.plans.cleaning import clean

    rows = [("r", c, t, float(c * (t % 5))) for c in range(3) for t in range(20)]
    df = spark.createDataFrame(rows, "rec string, chan long, t long, x double")
    assert clean(df, ["rec"], []).count() == 60
    out = clean(df, ["rec"], [("drop_flat", {}), ("crop", {"start": 5, "stop": 15}), ("reference", {})])
    assert {r.chan for r in out.collect()} == {1, 2} and out.count() == 20
    assert out.groupBy("t").agg(F.sum("x").alias("s")).where("abs(s) > 1e-12").isEmpty()
    w = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "target long, chan long, w double")
    made = clean(df, ["rec"], [("interpolate", {"weights": w})])
    assert made.count() == 60 and made.where("chan = 0").agg(F.max("x")).first()[0] == 6.0
    with pytest.raises(ValueError, match="nope"):
        clean(df, ["rec"], [("nope", {})])


def test_model_bundle(spark, tmp_path):
    from signalspark.operators import models

    rows = [(k, float(k % 7), float(k % 2) * 5, "on" if k % 2 else "off") for k in range(60)] + [(60, None, 1.0, "on")]
    df = spark.createDataFrame(rows, "id long, f double, g double, state string")
    models.train(df, ["f", "g"], "state", str(tmp_path / "m"), trees=5)
    got = models.predict(df.drop("state"), ["f", "g"], str(tmp_path / "m"), ["id"]).collect()
    assert len(got) == 60 and all(r.predicted == ("on" if r.id % 2 else "off") for r in got)
