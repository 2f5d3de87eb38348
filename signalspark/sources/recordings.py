"""Python data sources for binary recordings: EDF and BDF (read and write), Curry; ``register`` adds EBM channels and containers.

Files are planned on the driver by their headers and cut into ranges, so that a task reads some records of one file.
Filters on ``path``, ``chan`` and ``start`` reach the plan: only those bytes are read.
"""

from __future__ import annotations

import math
import os
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from signalspark.sources.storage import Wanted, exists, files, open_read

SEGMENTS = "path string, chan string, unit string, srate double, seg_no long, start timestamp, x array<double>"


class Part(InputPartition):
    def __init__(self, path: str, first: int, last: int, header: dict | None = None, chans: set | None = None):
        self.path, self.first, self.last, self.header, self.chans = path, first, last, header, chans


# --- EDF -----------------------------------------------------------------------------------------------------
#: Widths of the per-signal header fields of EDF.
SIGNAL_FIELDS = [("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)]


def edf_header(path: str) -> dict:
    with open_read(path) as f:
        head = f.read(256)
        n = int(head[252:256])
        raw = f.read(256 * n)
    start = datetime.strptime(head[168:184].decode("latin-1"), "%d.%m.%y%H.%M.%S").replace(tzinfo=timezone.utc)
    out = {"start": start, "records": int(head[236:244]), "seconds": float(head[244:252]), "bytes": int(head[184:192]), "wide": head[0] == 255}
    at = 0
    for name, width in SIGNAL_FIELDS:
        out[name] = [raw[at + k * width : at + (k + 1) * width].decode("latin-1").strip() for k in range(n)]
        at += n * width
    out["samples"] = [int(s) for s in out["samples"]]
    return out


def edf_records(path: str, header: dict, first: int, last: int, chans: set | None = None, raw: bool = False):
    """(record, channel, calibrated samples) of a range of records; with ``chans`` only the bytes of those are read.

    Annotation channels are left out, or, with ``raw``, all but them, as bytes."""
    width = 3 if header["wide"] else 2
    size = width * sum(header["samples"])
    ends = np.cumsum(np.array(header["samples"], np.int64) * width)
    use = [k for k, c in enumerate(header["label"]) if c.endswith("Annotations") == raw and (chans is None or c in chans)]
    spans = [(int(ends[k]) - header["samples"][k] * width, header["samples"][k] * width) for k in use]
    whole = sum(n for _, n in spans) * 2 > size
    with open_read(path) as f:
        for r in range(first, last):
            if whole:
                f.seek(header["bytes"] + r * size)
                record = f.read(size)
                parts = [record[a : a + n] for a, n in spans]
            else:
                parts = []
                for a, n in spans:
                    f.seek(header["bytes"] + r * size + a)
                    parts.append(f.read(n))
            for k, part, (_, n) in zip(use, parts, spans, strict=True):
                if len(part) < n:
                    return
                if raw:
                    yield r, k, part
                    continue
                if width == 2:
                    v = np.frombuffer(part, "<i2").astype(float)
                else:
                    b = np.frombuffer(part, np.uint8).reshape(-1, 3).astype(np.int32)
                    v = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16).astype(np.int64)
                    v = np.where(v >= 1 << 23, v - (1 << 24), v).astype(float)
                dmin, dmax, pmin, pmax = (float(header[x][k]) for x in ("dmin", "dmax", "pmin", "pmax"))
                yield r, k, (v - dmin) * (pmax - pmin) / (dmax - dmin) + pmin


class EdfReader(DataSourceReader):
    def __init__(self, options, annotations: bool = False):
        self.path, self.records, self.annotations = options["path"], int(options.get("recordsPerTask", "600")), annotations
        self.wanted = Wanted()

    def pushFilters(self, filters):
        self.wanted = Wanted(filters)
        return filters

    def partitions(self):
        out = []
        for path in files(self.path):
            if self.wanted.takes("path", path):
                h = edf_header(path)
                rows = self.wanted.rows(h["start"], h["seconds"], h["records"]) if h["seconds"] else range(h["records"])
                out += [Part(path, a, min(rows.stop, a + self.records), h, self.wanted.names.get("chan")) for a in range(rows.start, rows.stop, self.records)]
        return out or [Part("", 0, 0)]

    def read(self, partition):
        h = partition.header
        for r, k, v in edf_records(partition.path, h, partition.first, partition.last, partition.chans, self.annotations) if h else ():
            if self.annotations:
                yield from ((partition.path, r, *found) for found in edf_annotations(v))
            else:
                start = h["start"] + timedelta(seconds=r * h["seconds"])
                yield partition.path, h["label"][k], h["unit"][k], h["samples"][k] / h["seconds"], r, start, v.tolist()


def edf_annotations(signal: bytes):
    """(onset, duration, text) of an annotation signal's record; the stamp of the record itself has no text and is left out."""
    for entry in signal.split(b"\x00"):
        stamp, *texts = entry.split(b"\x14")
        onset, _, duration = stamp.partition(b"\x15")
        for text in texts:
            if text and onset:
                yield float(onset), float(duration) if duration else None, text.decode("utf-8")


def _field(v, width: int) -> bytes:
    return str(v)[:width].ljust(width).encode("latin-1")


def _eight(v: float, towards) -> str:
    """A number in at most eight characters, rounded by ``towards`` at its last digit."""
    for digits in range(6, -1, -1):
        text = f"{towards(v * 10**digits) / 10**digits:.{digits}f}"
        if len(text) <= 8:
            return text
    raise ValueError(f"{v} does not fit in a header")


def edf_bytes(channels: list[tuple[str, str, float, list[float]]], start: datetime) -> bytes:
    """A plain EDF file of one-second records from (label, unit, srate, samples) per channel; the last record is padded.

    The header has eight characters for a range, so values all below 0.01 are written in millionths, as uV for V."""
    n = len(channels)
    tiny = [0 < max((abs(v) for v in c[3]), default=0.0) < 0.01 for c in channels]
    channels = [(label, f"u{unit}", rate, [v * 1e6 for v in x]) if small else (label, unit, rate, x) for (label, unit, rate, x), small in zip(channels, tiny, strict=True)]
    spans = []
    for _, _, _, x in channels:
        lo, hi = min(x, default=0.0), max(x, default=1.0)
        spans.append((lo, hi if hi > lo else lo + 1.0))
    # What stands in the header's eight characters is what counts: it encloses the values.
    texts = [(_eight(lo, math.floor), _eight(hi, math.ceil)) for lo, hi in spans]
    rates = [int(round(c[2])) for c in channels]
    records = max((-(-len(c[3]) // r) for c, r in zip(channels, rates, strict=True)), default=0)
    head = _field("0", 8) + _field("X X X X", 80) + _field("Startdate X X X X", 80) + start.strftime("%d.%m.%y%H.%M.%S").encode()
    head += _field(256 * (n + 1), 8) + _field("", 44) + _field(records, 8) + _field(1, 8) + _field(n, 4)
    columns = {
        "label": [c[0] for c in channels], "transducer": [""] * n, "unit": [c[1] for c in channels], "pmin": [t[0] for t in texts], "pmax": [t[1] for t in texts],
        "dmin": ["-32768"] * n, "dmax": ["32767"] * n, "filter": [""] * n, "samples": rates, "reserved": [""] * n,
    }
    head += b"".join(_field(v, width) for name, width in SIGNAL_FIELDS for v in columns[name])
    coded = []
    for (_, _, _, x), (a, b), r in zip(channels, texts, rates, strict=True):
        lo, hi = float(a), float(b)
        v = np.round((np.array(x, float) - lo) / (hi - lo) * 65535 - 32768)
        coded.append(np.concatenate([np.clip(v, -32768, 32767), np.zeros(records * r - len(x))]).astype("<i2"))
    return head + b"".join(c[k * r : (k + 1) * r].tobytes() for k in range(records) for c, r in zip(coded, rates, strict=True))


class EdfWriter(DataSourceWriter):
    """Writes short recordings: a task writes one file per recording (path) that it holds, in memory, so rows should be
    repartitioned by path. ``edf_export.write_edf`` writes recordings of any length."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        held: dict[str, dict] = {}
        for row in iterator:
            chans = held.setdefault(row["path"], {})
            chans.setdefault((row["chan"], row["unit"], row["srate"]), []).append((row["seg_no"], row["start"], row["x"]))
        os.makedirs(self.path, exist_ok=True)
        for name, chans in held.items():
            rows = [(c, u or "", s, [v for _, _, x in sorted(parts, key=lambda p: p[0]) for v in x]) for (c, u, s), parts in sorted(chans.items())]
            start = min(p[1] for parts in chans.values() for p in parts)
            to = os.path.join(self.path, os.path.splitext(os.path.basename(name))[0] + ".edf")
            with open(f"{to}.tmp", "wb") as f:
                f.write(edf_bytes(rows, start))
            os.replace(f"{to}.tmp", to)
        return WriterCommitMessage()


class EdfSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return SEGMENTS

    def reader(self, schema):
        return EdfReader(self.options)

    def writer(self, schema, overwrite):
        return EdfWriter(self.options)


class EdfAnnotations(DataSource):
    """Annotations of EDF+ and BDF+ files: (path, record, onset in seconds, duration, text)."""

    @classmethod
    def name(cls):
        return "edf_annotations"

    def schema(self):
        return "path string, seg_no long, onset double, duration double, text string"

    def reader(self, schema):
        return EdfReader(self.options, annotations=True)


# --- Curry ---------------------------------------------------------------------------------------------------
def curry_parameters(text: str) -> dict:
    """Sizes, rate, labels and events of a parameter file: 'key = value' lines and START_LIST/END_LIST blocks."""
    plain = {"numsamples": "samples", "num_samples": "samples", "numchannels": "channels", "num_channels": "channels", "samplefreqhz": "srate", "sample_freq_hz": "srate"}
    out: dict = {"samples": 0, "channels": 0, "srate": 0.0, "labels": [], "events": [], "ascii": False}
    block = None
    for line in text.splitlines():
        words = line.split()
        if "START_LIST" in line:
            block = words[0]
        elif "END_LIST" in line:
            block = None
        elif block and block.startswith("LABELS"):
            out["labels"].append(line.strip())
        elif block and block.startswith("NUMBER_LIST"):
            n = [int(float(w)) for w in words]
            if len(n) >= 6:
                out["events"].append((n[0], n[2], n[4], n[5]))
        elif "=" in line and not block:
            key, value = (x.strip() for x in line.split("=", 1))
            if key.lower() in ("dataformat", "data_format"):
                out["ascii"] = value.upper().startswith("ASCII")
            if key.lower() in plain:
                out[plain[key.lower()]] = float(value)
    return out


class CurryReader(DataSourceReader):
    """``path``: parameter files (.dpa, .dpo); the data lie beside them (.dat or .cdt), float32, one time after another, or
    as text (a line per time). Rows of ``samplesPerTask`` times; a filter on ``start`` reaches the plan."""

    def __init__(self, options):
        self.path, self.rows, self.wanted = options["path"], int(options.get("samplesPerTask", "100000")), Wanted()

    def pushFilters(self, filters):
        self.wanted = Wanted(filters)
        return filters

    def partitions(self):
        out = []
        for path in files(self.path):
            if path.endswith((".dpa", ".dpo", ".dap")) and self.wanted.takes("path", path):
                with open_read(path) as f:
                    p = curry_parameters(f.read().decode("latin-1"))
                base = os.path.splitext(path)[0]
                data = next((d for d in (f"{base}.dat", f"{base}.cdt", base) if exists(d)), None)
                if data is None:
                    raise FileNotFoundError(f"no data beside {path}")
                n, p = int(p["samples"]), p | {"data": data, "start": datetime(1970, 1, 1, tzinfo=timezone.utc)}
                blocks = self.wanted.rows(p["start"], self.rows / (p["srate"] or 1.0), -(-n // self.rows))
                out += [Part(path, b * self.rows, min(n, (b + 1) * self.rows), p) for b in blocks]
        return out or [Part("", 0, 0)]

    def read(self, partition):
        p = partition.header
        if not p:
            return
        n, times = int(p["channels"]), partition.last - partition.first
        with open_read(p["data"]) as f:
            if not p["ascii"]:
                f.seek(4 * n * partition.first)
                block = np.frombuffer(f.read(4 * n * times), "<f4").reshape(-1, n)
            else:
                lines = (line for k, line in enumerate(f.read().decode("latin-1").splitlines()) if partition.first <= k < partition.last)
                block = np.array([[float(v) for v in line.split()] for line in lines])
        start = p["start"] + timedelta(seconds=partition.first / (p["srate"] or 1.0))
        for k in range(n):
            label = p["labels"][k] if k < len(p["labels"]) else f"ch{k}"
            yield partition.path, label, "uV", p["srate"], partition.first // self.rows, start, block[:, k].astype(float).tolist()


class CurrySource(DataSource):
    @classmethod
    def name(cls):
        return "curry"

    def schema(self):
        return SEGMENTS

    def reader(self, schema):
        return CurryReader(self.options)


def register(spark) -> None:
    """Makes the formats edf, edf_annotations, curry, ebm, ebm_header, ebm_sequences and container known to a session, and lets
    filters reach them."""
    from signalspark.sources.container import ContainerSource
    from signalspark.sources.ebm import EbmHeaders, EbmSequences, EbmSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EdfSource, EdfAnnotations, CurrySource, EbmSource, EbmHeaders, EbmSequences, ContainerSource):
        spark.dataSource.register(source)
