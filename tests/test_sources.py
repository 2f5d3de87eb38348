import math
import struct
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import timeline
from signalspark.sources import ebm, edf_export, recordings, sleep, tables


def test_bess_text(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("BESS Text Export\nFz (uV)\nCz (uV)\nSamplingRate = 4.0, Samples = 3\n1.5\t-2\n3\t4e0\n5\t6\n")
    header, samples = tables.read_bess(spark, str(tmp_path))
    assert header.select("srate", "channels").first() == (4.0, ["Fz", "Cz"])
    got = samples.orderBy("i", "chan").select("i", "t", "chan", "x").collect()
    assert [tuple(r) for r in got][:3] == [(0, 0.0, "Cz", -2.0), (0, 0.0, "Fz", 1.5), (1, 0.25, "Cz", 4.0)]


def test_edf_round_trip(spark, tmp_path):
    recordings.register(spark)
    r = np.random.default_rng(0)
    rows = [("rec1", c, "uV", 16.0, s, datetime(2020, 1, 2, 3, 4, 5 + s), r.normal(0, 50, 16).tolist()) for c in ("Fz", "Cz") for s in range(5)]
    df = spark.createDataFrame(rows, recordings.SEGMENTS)
    df.repartition("path").write.format("edf").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("edf").option("recordsPerTask", "2").load(str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 3
    got = {(b["chan"], b["seg_no"]): b for b in back.collect()}
    for _, chan, _, srate, seg, start, x in rows:
        b = got[chan, seg]
        assert b["srate"] == srate and b["start"] == start
        assert np.abs(np.array(b["x"]) - x).max() < 0.02


def ebm_file(path, name=b"Fz", rate=10.0, starts=((1, 35), (9, 20)), wide=True, function=b"", spread=(-327.67, 327.67, 0.01)):
    """A file of sequences that begin at second s and hold n samples each: k, k + 1, ..."""
    rec = lambda m, b: struct.pack("<II" if wide else "<HI", m, len(b)) + b
    data = b"Embla data file\x1a\x00" + (b"\xff" * 5 + bytes(26) if wide else b"\x00")
    data += rec(ebm.NAME, name + b"\0") + rec(ebm.RATE, struct.pack("<d", rate)) + rec(ebm.UNIT, b"uV\0") + rec(ebm.RAW_RANGE, struct.pack("<3d", *spread))
    data += rec(0xD0, b"Somebody\0") + rec(0x95, b"xx") + (rec(ebm.FUNCTION, function) if function else b"")
    k = 0
    for s, n in starts:
        data += rec(ebm.TIME, struct.pack("<H6B", 2021, 5, 6, 7, 8, s, 50))
        data += rec(ebm.DATA, np.arange(k, k + n).astype("<i2" if wide else "i1").tobytes())
        k += n
    path.write_bytes(data)


def test_ebm_segments_headers_and_sequences(spark, tmp_path):
    ebm_file(tmp_path / "a.ebm")
    ebm_file(tmp_path / "b.ebm", b"Cz", wide=False, function=b"2*x+1", spread=(-32767.0, 32767.0, 0.0))
    recordings.register(spark)
    got = spark.read.format("ebm").option("rowsPerTask", "2").load(str(tmp_path)).orderBy("chan", "seg_no", "first").collect()
    fz = [g for g in got if g["chan"] == "Fz"]
    assert [(g["seg_no"], g["first"], len(g["x"])) for g in fz] == [(0, 0, 10), (0, 10, 10), (0, 20, 10), (0, 30, 5), (1, 0, 10), (1, 10, 10)]
    assert [v for g in fz for v in g["x"]] == pytest.approx([k / 100 for k in range(55)])
    assert fz[1]["start"] == datetime(2021, 5, 6, 7, 8, 2, 500_000) and fz[4]["start"] == datetime(2021, 5, 6, 7, 8, 9, 500_000)
    assert [v for g in got if g["chan"] == "Cz" for v in g["x"]] == pytest.approx([2 * k + 1 for k in range(55)])
    heads = {(r["path"][-5:], r["name"]): r["value"] for r in spark.read.format("ebm_header").load(str(tmp_path)).collect()}
    assert heads["a.ebm", "subject_name"] == "Somebody" and heads["b.ebm", "calibration_function"] == "2*x+1" and heads["a.ebm", "rate"] == "10.0"
    seqs = spark.read.format("ebm_sequences").load(str(tmp_path))
    assert [(r["chan"], r["seq"], r["n"]) for r in seqs.orderBy("chan", "seq").collect()] == [("Cz", 0, 35), ("Cz", 1, 20), ("Fz", 0, 35), ("Fz", 1, 20)]
    assert [(r["chan"], r["seq"], r["seconds"]) for r in ebm.gaps(seqs).orderBy("chan").collect()] == [("Cz", 0, 4.5), ("Fz", 0, 4.5)]
    with pytest.raises(ValueError, match="EBM"):
        (tmp_path / "c.ebm").write_bytes(b"something else")
        ebm.channel(str(tmp_path / "c.ebm"))


class Counted:
    """Counts what is read of a file."""

    def __init__(self, path, reads):
        self.f, self.reads = open(path, "rb"), reads

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read(self, n=-1):
        out = self.f.read(n)
        self.reads.append((self.f.tell() - len(out), len(out)))
        return out

    def seek(self, *a):
        return self.f.seek(*a)

    def tell(self):
        return self.f.tell()


def test_a_time_range_reads_its_bytes_only(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    path = tmp_path / "a.ebm"
    ebm_file(path, starts=((0, 20_000), (59, 30)))
    size, reads = path.stat().st_size, []
    monkeypatch.setattr(ebm, "open_read", lambda p: Counted(p, reads))
    reader = ebm.EbmReader({"path": str(path), "rowsPerTask": "16"})
    low, high = datetime(2021, 5, 6, 7, 10, tzinfo=timezone.utc), datetime(2021, 5, 6, 7, 11, tzinfo=timezone.utc)
    reader.pushFilters([GreaterThanOrEqual(("start",), low), LessThan(("start",), high), EqualTo(("chan",), "Fz")])
    parts = reader.partitions()
    assert sum(n for _, n in reads) < 500 < size
    reads.clear()
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 4 and 60 <= sum(low <= r[5] < high for r in rows) <= len(rows) <= 62
    assert sum(n for _, n in reads) == sum(len(r[6]) for r in rows) * 2
    reader.pushFilters([EqualTo(("chan",), "Cz")])
    assert [r for p in reader.partitions() for r in reader.read(p)] == []
    # The same through Spark, as a scan of the range.
    monkeypatch.undo()
    recordings.register(spark)
    df = spark.read.format("ebm").load("file://" + str(path)).where("chan = 'Fz' and start >= timestamp'2021-05-06 07:10:00' and start < timestamp'2021-05-06 07:11:00'")
    assert df.count() == 60 and df.rdd.getNumPartitions() == 1
    samples = ebm.samples(df)
    seqs = spark.createDataFrame([(r["path"], "Fz", 0, 0.5, 20_000) for r in df.select("path").distinct().collect()], "path string, chan string, seq long, start double, n long")
    scan = timeline.range_scan(samples, seqs, ["path", "chan"], 10.0, 130.0, 132.0).orderBy("i").collect()
    assert [r["x"] for r in scan] == pytest.approx([(1295 + k) / 100 for k in range(20)])


def test_edf_reads_the_bytes_of_wanted_channels(tmp_path, monkeypatch):
    from pyspark.sql.datasource import In

    path = tmp_path / "a.edf"
    path.write_bytes(recordings.edf_bytes([(f"C{k}", "uV", 100.0, [float(k + i % 7) for i in range(500)]) for k in range(10)], datetime(2020, 1, 1)))
    reads = []
    reader = recordings.EdfReader({"path": str(path)})
    reader.pushFilters([In(("chan",), ["C3", "C7"])])
    (part,) = reader.partitions()
    monkeypatch.setattr(recordings, "open_read", lambda p: Counted(p, reads))
    rows = list(reader.read(part))
    assert sum(n for _, n in reads) == 2 * 500 * 2 and {r[1] for r in rows} == {"C3", "C7"}
    assert np.concatenate([r[6] for r in rows if r[1] == "C3"]) == pytest.approx([3.0 + i % 7 for i in range(500)], abs=1e-3)


def entry(kind, name, data):
    name = name.encode() + b"\0"
    return struct.pack("<iiHH", 12 + len(data) + len(name), len(data), kind, 0) + data + name


def parcel(*entries):
    body = b"".join(entries)
    return struct.pack("<HIH", 1, 8 + len(body), 13) + body


def test_container_tree(spark, tmp_path):
    inner = parcel(entry(3, "who", "Zo\u00eb".encode("cp1252") + b"\0"), entry(8, "n", struct.pack("<i", -5)), entry(2000, "ev", b"\1" * 112))
    tree = parcel(entry(6, "w", struct.pack("<H", 7)), entry(13, "sub", inner), entry(15, "span", struct.pack("<qi4x", 3, 250)), entry(4, "flag", b"\0\1"), entry(13, "none", parcel()))
    (tmp_path / "a.bin").write_bytes(tree)
    recordings.register(spark)
    df = spark.read.format("container").load(str(tmp_path))
    got = {(r["place"], r["name"]): r for r in df.collect()}
    assert {k: r["value"] for k, r in got.items() if r["value"] is not None} == {("/", "w"): "7", ("/sub/", "who"): "Zo\u00eb", ("/sub/", "n"): "-5", ("/", "span"): "3.25", ("/", "flag"): "true"}
    assert len(got) == 8 and got["/sub/", "ev"]["data"] == b"\1" * 112 and got["/", "sub"]["type"] == "parcel" and got["/", "flag"]["n"] == 3
    assert [r["value"] for r in df.where("name = 'n' and place like '/sub%'").collect()] == ["-5"]
    (tmp_path / "a.bin").write_bytes(struct.pack("<HIH", 1, len(tree) - 3, 13) + tree[8:])
    with pytest.raises(Exception, match="container|entry"):
        df.collect()


@pytest.mark.parametrize("kind", ["edf", "bdf"])
def test_export_in_parts_with_annotations(spark, tmp_path, kind):
    recordings.register(spark)
    r = np.random.default_rng(0)
    x = {c: r.normal(0, 50, 16 * 50) for c in ("Fz", "Cz")}
    rows = [(f"in/{p}.dat", c, "uV", 16.0, s, datetime(2020, 1, 2, 3, 4) + timedelta(seconds=s), x[c][16 * s : 16 * s + 16].tolist()) for p in "ab" for c in x for s in range(50) if (c, s) != ("Cz", 20)]
    df = spark.createDataFrame(rows, recordings.SEGMENTS).repartition(5)
    notes = spark.createDataFrame([("in/a.dat", 3.25, 0.5, "blink"), ("in/a.dat", 31.0, None, "née"), ("in/a.dat", 31.5, 2.0, "x" * 90), ("in/a.dat", 99.0, 1.0, "out")], "path string, onset double, duration double, text string")
    out = str(tmp_path / "out")
    assert edf_export.write_edf(df, out, kind, notes, tmin=2.0, tmax=40.0, task_records=7) == [f"a.{kind}", f"b.{kind}"]
    import os

    assert sorted(os.listdir(out)) == [f"a.{kind}", f"b.{kind}"]
    back = spark.read.format("edf").load(out)
    got = {(b["path"][-5], b["chan"], b["seg_no"]): b for b in back.collect()}
    assert len(got) == 2 * 2 * 38
    for (_, chan, k), b in got.items():
        want = np.zeros(16) if (chan, k) == ("Cz", 18) else x[chan][16 * (k + 2) : 16 * (k + 3)]
        assert np.abs(np.array(b["x"]) - want).max() < (0.01 if kind == "edf" else 1e-4)
        assert b["start"] == datetime(2020, 1, 2, 3, 4, 2) + timedelta(seconds=k)
    told = spark.read.format("edf_annotations").load(out).orderBy("onset").collect()
    assert [(t["path"][-5], t["seg_no"], t["onset"], t["duration"], t["text"]) for t in told] == [("a", 1, 1.25, 0.5, "blink"), ("a", 29, 29.0, None, "née"), ("a", 29, 29.5, 2.0, "x" * 90)]


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    rows = [("in/a.dat", "Fz", "uV", 4.0, s, datetime(2020, 1, 1) + timedelta(seconds=s), [1.0] * (4 if s < 30 else 5)) for s in range(40)]
    out = tmp_path / "out"
    with pytest.raises(Exception, match="5 samples"):
        edf_export.write_edf(spark.createDataFrame(rows, recordings.SEGMENTS), str(out), task_records=8)
    assert list(out.iterdir()) == []


def test_curry_text_data(spark, tmp_path):
    (tmp_path / "a.dpa").write_text("NumSamples = 3\nNumChannels = 2\nSampleFreqHz = 10\nDataFormat = ASCII\nLABELS START_LIST\nFz\nCz\nLABELS END_LIST\n")
    (tmp_path / "a.dat").write_text("1 2\n3 4\n5 6.5\n")
    recordings.register(spark)
    got = spark.read.format("curry").option("samplesPerTask", "2").load(str(tmp_path)).orderBy("chan", "seg_no").collect()
    assert [(g["chan"], g["x"]) for g in got] == [("Cz", [2, 4]), ("Cz", [6.5]), ("Fz", [1, 3]), ("Fz", [5])]


def test_curry(spark, tmp_path):
    (tmp_path / "a.dpa").write_text("NumSamples = 5\nNumChannels = 2\nSampleFreqHz = 10\nLABELS START_LIST\nFz\nCz\nLABELS END_LIST\nNUMBER_LIST START_LIST\n3 0 17 0 3 4 0 0 0 0 0\nNUMBER_LIST END_LIST\n")
    np.arange(10, dtype="<f4").tofile(tmp_path / "a.dat")
    recordings.register(spark)
    got = spark.read.format("curry").option("samplesPerTask", "3").load(str(tmp_path)).orderBy("chan", "seg_no").collect()
    assert [(g["chan"], g["x"]) for g in got] == [("Cz", [1, 3, 5]), ("Cz", [7, 9]), ("Fz", [0, 2, 4]), ("Fz", [6, 8])]
    assert recordings.curry_parameters((tmp_path / "a.dpa").read_text())["events"] == [(3, 17, 3, 4)]


def test_positions_and_neighbours(spark, tmp_path):
    (tmp_path / "p.csv").write_text("X,Y,Z,channels\n0,0,90,Cz\n0,30,85,Fz\n80,0,0,T8\n")
    p = tables.read_positions(spark, str(tmp_path / "p.csv"))
    assert {r["chan"]: (r["x"], r["y"]) for r in p.collect()}["T8"] == (0.0, pytest.approx(0.08))
    assert {(r["a"], r["b"]) for r in tables.adjacency(p, 0.05).collect()} == {("Cz", "Fz"), ("Fz", "Cz")}
    known, unknown = tables.standardise(spark.createDataFrame([("cz",), ("foo",)], "chan string"), p)
    assert [r["standard"] for r in known.collect()] == ["Cz"] and [r["chan"] for r in unknown.collect()] == ["foo"]


def test_lead_matrix(spark):
    g = spark.createDataFrame([("Cz", "Cz", 1.0), ("Cz", "Fz", 0.5), ("Fz", "Cz", 0.5), ("Fz", "Fz", 2.0)], "a string, b string, g double")
    got = tables.lead_matrix(g, spark.createDataFrame([("CZ",), ("fz",)], "label string"))
    assert {(r["a"], r["b"]): r["g"] for r in got.collect()}[("CZ", "fz")] == 0.5
    with pytest.raises(ValueError, match="Pz"):
        tables.lead_matrix(g, spark.createDataFrame([("Pz",)], "label string"))


def test_generators(spark):
    s = tables.sine(spark, 10.0, 2.0, 500.0, 1.0, 90.0).orderBy("i").collect()
    assert len(s) == 500 and s[0]["x"] == pytest.approx(2.0) and s[-1]["t"] == pytest.approx(1.0)
    x = np.array([r["x"] for r in tables.pink_noise(spark, 4096).orderBy("i").collect()])
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2
    f = np.arange(1, 1000)
    slope = np.polyfit(np.log(f), np.log(p[1:1000]), 1)[0]
    assert -1.5 < slope < -0.5


def test_logs_and_sinks(spark, tmp_path):
    tables.append_log(spark, str(tmp_path / "log"), file="a", steps=3)
    tables.append_log(spark, str(tmp_path / "log"), file="b", steps=4)
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    path = tables.write_clean(spark.range(3), str(tmp_path / "r"), 2)
    assert path.endswith("r_clean_02") and spark.read.parquet(path).count() == 3


def test_sleep_names(spark):
    rows = spark.createDataFrame([("SLEEP-S0",), ("SLEEP-S2",), ("SLEEP-REM",), ("LIGHTS",)], "n string")
    assert [r[0] for r in rows.select(sleep.stage_code(F.col("n"))).collect()] == [0, 2, 4, None]
    kinds = spark.createDataFrame([("EKG 1",), ("eeg Fz",), ("foo",)], "n string").select(sleep.channel_type(F.col("n")))
    assert [r[0] for r in kinds.collect()] == ["ECG", "EEG", "MISC"]


@pytest.mark.parametrize("text,want", [("0.5*x-3", (0.5, -3.0)), ("x", (1.0, 0.0)), (" 2e-1 * x + 4.5 ", (0.2, 4.5))])
def test_calibration_text(text, want):
    assert sleep.parse_calibration(text) == pytest.approx(want)


def test_calibration_is_never_evaluated():
    with pytest.raises(ValueError):
        sleep.parse_calibration("__import__('os').system('x')*x")


def test_from_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "e long, Fz array<double>, Cz array<double>")
    got = tables.from_arrays(df, "e", ["Fz", "Cz"], 2.0).collect()
    assert [(g["chan"], g["x"]) for g in got] == [("Fz", [1.0, 2.0]), ("Cz", [3.0])]
    assert math.isclose(got[0]["srate"], 2.0)


def test_edf_of_volts_is_written_in_microvolts():
    from datetime import datetime

    from signalspark.sources.recordings import edf_bytes

    x = [5e-5 * math.sin(k / 5) for k in range(256)]
    data = edf_bytes([("C3", "V", 256.0, x)], datetime(2020, 1, 1))
    assert data[192:236].strip() == b"" and data[352:360].strip() == b"uV"
    low, high = float(data[360:368]), float(data[368:376])
    assert low <= min(x) * 1e6 and high >= max(x) * 1e6 and high - low < 101
