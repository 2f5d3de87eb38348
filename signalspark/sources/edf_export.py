"""EDF and BDF files of recordings of any length, with annotations and cropping.

Three steps: ranges and headers from aggregates; tasks that each write the bytes of some records of a recording into a staging
folder; tasks that each put a recording's parts together as a stream. Files get their names when all are complete, and the
staging folder is removed whatever happens, so a failed job leaves nothing. No task holds more than ``task_records`` records.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators.lineage import cut
from signalspark.sources.recordings import SIGNAL_FIELDS, _eight, _field
from signalspark.sources.storage import place

#: Sample width and digital range of both formats.
KINDS = {"edf": (2, -32768, 32767), "bdf": (3, -8388608, 8388607)}


def _coded(v: np.ndarray, kind: str) -> bytes:
    if kind == "edf":
        return v.astype("<i2").tobytes()
    return np.ascontiguousarray(v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _header(kind: str, start: datetime, records: int, seconds: float, channels: list[dict], note_samples: int) -> bytes:
    width, low, high = KINDS[kind]
    marks = [{"chan": f"{kind.upper()} Annotations", "unit": "", "pmin": "-1", "pmax": "1", "samples": note_samples}] if note_samples else []
    rows = [*channels, *marks]
    n = len(rows)
    reserved = (f"{kind.upper()}+C" if note_samples else "24BIT" if kind == "bdf" else "")
    head = (b"\xffBIOSEMI" if kind == "bdf" else _field("0", 8)) + _field("X X X X", 80)
    head += _field(f"Startdate {start.strftime('%d-%b-%Y').upper()} X X X", 80) + start.strftime("%d.%m.%y%H.%M.%S").encode()
    head += _field(256 * (n + 1), 8) + _field(reserved, 44) + _field(records, 8) + _field(f"{seconds:g}", 8) + _field(n, 4)
    fields = {
        "label": [r["chan"] for r in rows], "transducer": [""] * n, "unit": [r["unit"] for r in rows], "pmin": [r["pmin"] for r in rows], "pmax": [r["pmax"] for r in rows],
        "dmin": [low] * n, "dmax": [high] * n, "filter": [""] * n, "samples": [r["samples"] for r in rows], "reserved": [""] * n,
    }
    return head + b"".join(_field(v, w) for name, w in SIGNAL_FIELDS for v in fields[name])


def _note(onset: float, duration: float | None, text: str) -> bytes:
    return f"{onset:+.6g}".encode() + (f"\x15{duration:g}".encode() if duration is not None and duration == duration else b"") + b"\x14" + text.encode() + b"\x14\x00"


def _stamp(record: int, seconds: float) -> bytes:
    return f"{record * seconds:+g}".encode() + b"\x14\x14\x00"


def _plan(segments: DataFrame, notes: DataFrame | None, kind: str, seconds: float, tmin: float, tmax: float | None):
    """(rows cut to the time range with their ``record``, notes with theirs, one row per recording: name, start, records, channels)."""
    zero = segments.groupBy("path").agg(F.min("seg_no").alias("zero"), F.min("start").alias("start"))
    skip = math.floor(tmin / seconds + 1e-9)
    keep = None if tmax is None else math.ceil(tmax / seconds - 1e-9) - skip
    rows = segments.join(zero.select("path", "zero"), "path").withColumn("record", F.col("seg_no") - F.col("zero") - skip).where("record >= 0")
    if keep is not None:
        rows = rows.where(F.col("record") < keep)
    rows = rows.select("path", "chan", "unit", "srate", "record", "x")
    ends = rows.groupBy("path").agg((F.max("record") + 1).alias("records"))
    per = rows.groupBy("path", "chan").agg(
        F.first("unit", True).alias("unit"), F.max("srate").alias("srate"), F.min(F.array_min(F.filter("x", lambda v: ~F.isnan(v)))).alias("low"), F.max(F.array_max(F.filter("x", lambda v: ~F.isnan(v)))).alias("high")
    )
    chans = per.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chan", "unit", "srate", "low", "high"))).alias("channels"))
    start = F.timestamp_micros(F.unix_micros("start") + F.lit(int(skip * seconds * 1e6)))
    heads = zero.join(ends, "path").join(chans, "path").select("path", start.alias("start"), "records", "channels", F.lit(0).alias("note_bytes"))
    if notes is not None:
        at = F.col("onset") - skip * seconds
        notes = notes.select("path", at.alias("onset"), F.col("duration").cast("double").alias("duration"), "text", F.floor(at / seconds).alias("record"))
        notes = notes.join(ends, "path").where("record >= 0 and record < records").drop("records")
        # A note takes its text and 40 bytes at most for its times and marks.
        room = notes.groupBy("path", "record").agg(F.sum(F.octet_length("text") + 40).alias("b")).groupBy("path").agg(F.max("b").alias("b"))
        heads = heads.join(room, "path", "left").withColumn("note_bytes", (F.coalesce("b", F.lit(0)) + 40).cast("int")).drop("b")
    return rows, notes, heads


def _layout(channels, kind: str, seconds: float) -> list[dict]:
    """Header values of the channels; values all below 0.01 are written in millionths, as uV for V."""
    out = []
    for c in channels:
        low, high = c["low"], c["high"]
        low, high = (0.0, 1.0) if low is None or low != low else (low, high)
        factor = 1e6 if 0 < max(abs(low), abs(high)) < 0.01 else 1.0
        low, high = low * factor, high * factor
        high = high if high > low else low + 1.0
        unit = c["unit"] or ""
        out.append({"chan": c["chan"], "unit": f"u{unit}" if factor > 1 else unit, "pmin": _eight(low, math.floor), "pmax": _eight(high, math.ceil), "samples": round(c["srate"] * seconds), "factor": factor})
    return out


def write_edf(
    segments: DataFrame, path: str, kind: str = "edf", annotations: DataFrame | None = None, record_seconds: float = 1.0, tmin: float = 0.0, tmax: float | None = None, task_records: int = 3600
) -> list[str]:
    """Writes one file per ``path`` of the segments (path, chan, unit, srate, seg_no, start, x) and returns their names.

    A row holds a channel's samples of one record of ``record_seconds``, ``seg_no`` its number, as ``format("edf")`` and
    ``format("ebm")`` read them; shorter rows, absent rows and null or NaN samples are filled with 0 (or the nearest value of the range).
    Of repeated rows one counts. ``annotations``: (path, onset in seconds from the first record, duration or null, text) become a
    signal. ``tmin`` and ``tmax`` crop to whole records. A file of the name is replaced. No rows: no files."""
    if kind not in KINDS:
        raise ValueError("kind is edf or bdf")
    width, least, most = KINDS[kind]
    system, root = place(path)
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    system.create_dir(place(staging)[1], recursive=True)
    seconds = float(record_seconds)
    rows, notes, heads = _plan(segments, annotations, kind, seconds, tmin, tmax)
    heads = cut(heads.withColumn("name", F.substring_index(F.col("path"), "/", -1)).withColumn("id", F.sha2("path", 256)))  # a row per recording
    try:
        parts = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("records") - 1) / task_records).cast("int"))))
        kinds = rows.withColumn("part", F.floor(F.col("record") / task_records).cast("int"))
        data = kinds.select("path", "part", "record", "chan", "x", F.lit(None).cast("double").alias("onset"), F.lit(None).cast("double").alias("duration"), F.lit(None).cast("string").alias("text"))
        if notes is not None:
            marks = notes.withColumn("part", F.floor(F.col("record") / task_records).cast("int"))
            data = data.unionByName(marks.select("path", "part", "record", F.lit(None).cast("string").alias("chan"), F.lit(None).cast("array<double>").alias("x"), "onset", "duration", "text"))

        def write_part(plan: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            if not len(plan):
                return pd.DataFrame({"path": [], "part": [], "bytes": []})
            p = plan.iloc[0]
            layout = _layout([c.asDict() if hasattr(c, "asDict") else c for c in p["channels"]], kind, seconds)
            first, last = int(p["nth"]) * task_records, min(int(p["records"]), (int(p["nth"]) + 1) * task_records)
            held = {(r, c): x for r, c, x in zip(got["record"], got["chan"], got["x"], strict=True) if c is not None}
            told: dict[int, list] = {}
            for r, a, d, t in got.loc[got["chan"].isna(), ["record", "onset", "duration", "text"]].sort_values(["onset", "text"]).itertuples(index=False):
                told.setdefault(int(r), []).append(_note(a, d, t))
            room = -(-int(p["note_bytes"]) // width) * width
            to, at = place(f"{staging}/{p['id']}-{int(p['nth']):08d}")
            temporary, size = f"{at}.{uuid.uuid4().hex}", 0
            with to.open_output_stream(temporary) as f:
                for r in range(first, last):
                    for c in layout:
                        low, high = float(c["pmin"]), float(c["pmax"])
                        x = held.get((r, c["chan"]))
                        v = np.zeros(c["samples"])
                        if x is not None:
                            if len(x) > c["samples"]:
                                raise ValueError(f"{len(x)} samples of {c['chan']} in a record of {c['samples']}")
                            v[: len(x)] = np.nan_to_num(np.array(x, float) * c["factor"])
                        coded = np.clip(np.round((v - low) / (high - low) * (most - least) + least), least, most)
                        size += f.write(_coded(coded, kind))
                    if room:
                        note = _stamp(r, seconds) + b"".join(told.get(r, []))
                        size += f.write(note.ljust(room, b"\0"))
            to.move(temporary, at)  # a repeated task replaces the same part
            return pd.DataFrame({"path": [p["recording"]], "part": [int(p["nth"])], "bytes": [size]})

        grouped = parts.select(F.col("path").alias("recording"), F.col("part").alias("nth"), "id", "records", "channels", "note_bytes").groupBy("recording", "nth").cogroup(data.groupBy("path", "part"))
        written = grouped.applyInPandas(lambda a, b: write_part(a, b), "path string, part int, bytes long").groupBy("path").agg(F.count("*").alias("parts"), F.sum("bytes").alias("bytes"))
        whole = heads.join(cut(written), "path")

        def put_together(batches):
            for b in batches:
                names = []
                for p in b.itertuples(index=False):
                    layout = _layout([c.asDict() if hasattr(c, "asDict") else c for c in p.channels], kind, seconds)
                    room = -(-int(p.note_bytes) // width) if p.note_bytes else 0
                    stem = posixpath.splitext(p.name)[0]
                    to, at = place(f"{staging}/whole-{stem}.{kind}")
                    start = pd.Timestamp(p.start).to_pydatetime().replace(tzinfo=timezone.utc)
                    temporary = f"{at}.{uuid.uuid4().hex}"
                    with to.open_output_stream(temporary) as f:
                        f.write(_header(kind, start, int(p.records), seconds, layout, room))
                        for k in range(int(p.parts)):
                            with to.open_input_stream(place(f"{staging}/{p.id}-{k:08d}")[1]) as part:
                                while block := part.read(1 << 20):
                                    f.write(block)
                    to.move(temporary, at)
                    names.append(f"{stem}.{kind}")
                yield pd.DataFrame({"name": names})

        names = sorted(r["name"] for r in whole.repartition("path").select("name", "id", "start", "records", "channels", "note_bytes", "parts").mapInPandas(put_together, "name string").toLocalIterator())
        if len(set(names)) < len(names):
            raise ValueError("two recordings of one name")
        for name in names:
            system.move(place(f"{staging}/whole-{name}")[1], posixpath.join(root, name))
        return names
    finally:
        if system.get_file_info(place(staging)[1]).type == fs.FileType.Directory:
            system.delete_dir(place(staging)[1])
