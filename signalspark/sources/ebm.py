"""EBM channel files: segments of samples by time range, header fields, and the sequences between gaps.

The driver reads record headers only and seeks over the samples. A task reads the bytes of its rows; filters on ``chan``,
``path`` and ``start`` reach the plan, so a query on a time range reads that range.
"""

from __future__ import annotations

import struct
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from signalspark.sources.sleep import parse_calibration
from signalspark.sources.storage import Wanted, files, open_read

#: Titles of a file, and markers of its records with how the payload is read (text, or a struct format).
TITLES = (b"Embla data file", b"Embla results file", b"Embla raw file")
DATA, TIME, RATE, RATE_CORRECTION, RAW_RANGE, NAME, FUNCTION, UNIT = 0x20, 0x84, 0x89, 0x8A, 0x8B, 0x90, 0x98, 0x99
FIELDS = {
    0x80: ("version", "2B"),
    0x81: ("header", "text"),
    0x84: ("time", "H6B"),
    0x85: ("channel", "h"),
    0x86: ("sampling", "I"),
    0x87: ("gain", "I"),
    0x88: ("session_count", "I"),
    0x89: ("rate", "d"),
    0x8A: ("rate_correction", "d"),
    0x8B: ("raw_range", "3d"),
    0x8C: ("transducer_range", "3d"),
    0x90: ("name", "text"),
    0x98: ("calibration_function", "text"),
    0x99: ("calibration_unit", "text"),
    0xC0: ("serial_number", "text"),
    0xC1: ("device_type", "text"),
    0xD0: ("subject_name", "text"),
    0xD1: ("subject_id", "text"),
    0x30: ("data_id", "text"),
    0x40: ("recording_id", "text"),
    0x020000A0: ("signal_type", "text"),
    0x03000070: ("signal_reference", "text"),
    0x03000072: ("signal_main_type", "text"),
    0x03000074: ("signal_sub_type", "text"),
}
LEAST, MOST = -32767, 32767


def scan(f) -> dict:
    """Header fields as a list of (marker, value), sequences as (first byte, samples), sample width and byte order.

    Only heads of records and payloads of fields are read. A file that ends inside a record ends before it."""
    head = f.read(32)
    at = head.find(b"\x1a")
    if at < 0 or head[:at] not in TITLES or head[at + 1 : at + 2] not in (b"\xff", b"\x00"):
        raise ValueError("not an EBM channel file")
    order = ">" if head[at + 1] == 255 else "<"
    wide = head[at + 2 : at + 7] == b"\xff" * 5
    at += 33 if wide else 3
    f.seek(0, 2)
    total, out = f.tell(), {"order": order, "width": 2 if wide else 1, "fields": [], "sequences": []}
    size = 8 if wide else 6
    while at + size <= total:
        f.seek(at)
        marker, n = struct.unpack("<II" if wide else "<HI", f.read(size))
        at += size
        if at + n > total:
            break
        if marker == DATA:
            out["sequences"].append((at, n // out["width"]))
        elif marker in FIELDS:
            kind = FIELDS[marker][1]
            body = f.read(n)
            out["fields"].append((marker, body.rstrip(b"\0").decode("latin-1") if kind == "text" else struct.unpack_from(order + kind, body)))
        at += n
    return out


def channel(path: str) -> dict:
    """Name, unit, rate, calibration (scale, offset) and sequences (first byte, samples, start) of a file."""
    with open_read(path) as f:
        s = scan(f)
    last = dict(s["fields"])
    starts = [datetime(y, mo, d, h, mi, sec, cs * 10_000, tzinfo=timezone.utc) for k, v in s["fields"] if k == TIME for y, mo, d, h, mi, sec, cs in [v]]
    low, high, step = last.get(RAW_RANGE, (float(LEAST), float(MOST), 1.0))
    scale, offset, least, most = step, 0.0, LEAST, MOST
    if step:
        least, most = int(low / step), int(high / step)
    elif abs(low) != abs(high):
        scale = max(abs(low), abs(high)) / MOST
    else:
        scale = (high - low) / (MOST - LEAST)
        offset = low - LEAST * scale
    if last.get(FUNCTION):  # a linear text; it is parsed, never evaluated
        a, b = parse_calibration(last[FUNCTION])
        scale, offset = a * scale, a * offset + b
    rate = last.get(RATE, (1.0,))[0]
    sequences = [(at, n, starts[min(k, len(starts) - 1)] if starts else datetime(1970, 1, 1, tzinfo=timezone.utc)) for k, (at, n) in enumerate(s["sequences"])]
    return {"path": path, "name": last.get(NAME, ""), "unit": last.get(UNIT, ""), "rate": rate, "scale": scale, "offset": offset, "least": least, "most": most, "sequences": sequences} | {k: s[k] for k in ("order", "width", "fields")}


class Rows(InputPartition):
    def __init__(self, file: dict, seq: int, first: int, last: int, per: int):
        self.file, self.seq, self.first, self.last, self.per = {k: v for k, v in file.items() if k not in ("sequences", "fields")}, seq, first, last, per
        self.at, self.n, self.start = file["sequences"][seq]


SCHEMA = "path string, chan string, unit string, srate double, seg_no long, start timestamp, x array<double>, first long"


class EbmReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.seconds, self.task_rows = options["path"], float(options.get("seconds", "1")), int(options.get("rowsPerTask", "3600"))
        self.wanted = Wanted()

    def pushFilters(self, filters):
        self.wanted = Wanted(filters)
        return filters

    def partitions(self):
        paths = [p for p in files(self.path) if self.wanted.takes("path", p)]
        with ThreadPoolExecutor(16) as pool:
            found = [c for c in pool.map(channel, paths) if self.wanted.takes("chan", c["name"])]
        out = []
        for c in found:
            per = max(1, round(c["rate"] * self.seconds))
            for seq, (_, n, start) in enumerate(c["sequences"]):
                rows = self.wanted.rows(start, per / c["rate"], -(-n // per))
                out += [Rows(c, seq, a, min(rows.stop, a + self.task_rows), per) for a in range(rows.start, rows.stop, self.task_rows)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if not isinstance(partition, Rows):
            return
        p, c = partition, partition.file
        with open_read(c["path"]) as f:
            f.seek(p.at + p.first * p.per * c["width"])
            for r in range(p.first, p.last):
                raw = f.read(min(p.per, p.n - r * p.per) * c["width"])
                v = np.clip(np.frombuffer(raw, f"{c['order']}i{c['width']}").astype(np.int64), c["least"], c["most"])
                start = p.start + timedelta(seconds=r * p.per / c["rate"])
                yield c["path"], c["name"], c["unit"], c["rate"], p.seq, start, (v * c["scale"] + c["offset"]).tolist(), r * p.per


class EbmSource(DataSource):
    """Rows of ``seconds`` (1) of samples; ``seg_no`` is the sequence and ``first`` the row's first sample in it."""

    @classmethod
    def name(cls):
        return "ebm"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EbmReader(self.options)


class HeaderReader(DataSourceReader):
    """One row per header field or per sequence; files are dealt to tasks, samples are never read."""

    def __init__(self, options, what: str):
        self.path, self.what, self.wanted = options["path"], what, Wanted()

    def pushFilters(self, filters):
        self.wanted = Wanted(filters)
        return filters

    def partitions(self):
        paths = [p for p in files(self.path) if self.wanted.takes("path", p)]
        return [InputPartition(paths[k : k + 64]) for k in range(0, len(paths), 64)] or [InputPartition([])]

    def read(self, partition):
        for path in partition.value:
            c = channel(path)
            if self.what == "fields":
                for k, (marker, v) in enumerate(c["fields"]):
                    yield path, k, marker, FIELDS[marker][0], v if isinstance(v, str) else ",".join(map(str, v))
            else:
                for seq, (_, n, start) in enumerate(c["sequences"]):
                    yield path, c["name"], seq, start, n, c["rate"]


class EbmHeaders(DataSource):
    @classmethod
    def name(cls):
        return "ebm_header"

    def schema(self):
        return "path string, n long, marker long, name string, value string"

    def reader(self, schema):
        return HeaderReader(self.options, "fields")


class EbmSequences(DataSource):
    @classmethod
    def name(cls):
        return "ebm_sequences"

    def schema(self):
        return "path string, chan string, seq long, start timestamp, n long, srate double"

    def reader(self, schema):
        return HeaderReader(self.options, "sequences")


def samples(segments: DataFrame) -> DataFrame:
    """(path, chan, seq, k, x) of segments, as ``timeline`` takes them."""
    rows = segments.select("path", "chan", F.col("seg_no").alias("seq"), "first", F.posexplode("x").alias("pos", "x"))
    return rows.select("path", "chan", "seq", (F.col("first") + F.col("pos")).alias("k"), "x")


def gaps(sequences: DataFrame) -> DataFrame:
    """(path, chan, seq, start, stop, seconds): the gap behind each sequence that another one follows later.

    Only sequences are ordered, never samples."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "chan").orderBy("start", "seq")
    stop = F.timestamp_micros((F.unix_micros("start") + F.col("n") / F.col("srate") * 1e6).cast("long"))
    rows = sequences.withColumn("until", F.lead("start").over(w)).withColumn("from", stop).where("until > from")
    return rows.select("path", "chan", "seq", F.col("from").alias("start"), F.col("until").alias("stop"), ((F.unix_micros("until") - F.unix_micros("from")) / 1e6).alias("seconds"))
