"""Matroska columns: EBML parsing into packet tables, and a writer for lossless payloads.

The parser walks variable-length elements, including segments and clusters of unknown size, and reads simple
blocks and block groups with Xiph, fixed-size and EBML lacing. Every packet comes with its track, timestamp and
byte range in the file, so payloads are cut out without copying the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
MUXING_APP, WRITING_APP = 0x4D80, 0x5741
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}

RATE, FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8000, 1024, 8, 4


# --- variable-length integers -------------------------------------------------------------------------------
def read_vint(data, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """(value, next offset, length); the value of an all-ones size is -1."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"truncated integer at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if not keep_marker:
        value &= (1 << 7 * length) - 1
        if value == (1 << 7 * length) - 1:
            value = -1
    return value, at + length, length


def write_size(n: int, length: int = 0) -> bytes:
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


# --- reading -------------------------------------------------------------------------------------------------
@dataclass
class Media:
    """Tables of one file. packets: (track, timestamp in ns, offset, size, keyframe, lacing, cluster number)."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # offsets of cluster elements
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, offset of the cluster


def elements(data, at: int, end: int):
    """(id, start of element, start of body, end of body or -1 if unknown) of the elements in a range."""
    while at < end:
        ident, body, _ = read_vint(data, at, True)
        size, body, _ = read_vint(data, body, False)
        stop = -1 if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element {ident:X} at byte {at} runs past its parent")
        yield ident, at, body, stop
        if stop < 0:
            return
        at = stop


def _number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _laced(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block body."""
    if not lacing:
        return [(at, end - at)]
    count = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for k in range(count - 1):
            if lacing == 1:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            else:
                n, at, length = read_vint(data, at, False)
                if k:
                    n = sizes[-1] + n - ((1 << 7 * length - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("lace sizes exceed their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def _block(data, a: int, b: int, media: Media, base: int, key: bool | None) -> None:
    track, at, _ = read_vint(data, a, False)
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    lacing = flags >> 1 & 3
    step = media.tracks.get(track, {}).get("duration", 0)
    for k, (start, size) in enumerate(_laced(data, at, b, lacing)):
        when = (base + relative) * media.scale + k * step
        media.packets.append((track, when, start, size, bool(flags & 0x80) if key is None else key, lacing, len(media.clusters) - 1))


def _cluster(data, at: int, end: int, media: Media) -> int:
    """Reads a cluster's elements; ends before an element that belongs to the segment. Returns where it ends."""
    base = 0
    for ident, start, a, b in elements(data, at, end):
        if ident in TOP_LEVEL:
            return start
        if b < 0:
            raise ValueError("only segments and clusters may have unknown sizes")
        if ident == TIMESTAMP:
            base = _number(data, a, b)
        elif ident == SIMPLE_BLOCK:
            _block(data, a, b, media, base, None)
        elif ident == BLOCK_GROUP:
            inner = list(elements(data, a, b))
            key = not any(x[0] == 0xFB for x in inner)  # a reference to another block
            for x, _, c, d in inner:
                if x == BLOCK:
                    _block(data, c, d, media, base, key)
        at = b
    return end


def _cue(data, a: int, b: int, media: Media, origin: int) -> None:
    time = 0
    for ident, _, c, d in elements(data, a, b):
        if ident == CUE_TIME:
            time = _number(data, c, d)
        elif ident == CUE_TRACK_POSITIONS:
            at = {x: _number(data, e, f) for x, _, e, f in elements(data, c, d) if x in (CUE_TRACK, CUE_CLUSTER_POSITION)}
            media.cues.append((time, at.get(CUE_TRACK, 0), origin + at.get(CUE_CLUSTER_POSITION, 0)))


def _track(data, a: int, b: int, media: Media) -> None:
    entry = {x: (c, d) for x, _, c, d in elements(data, a, b)}
    number = _number(data, *entry[TRACK_NUMBER])
    codec = bytes(data[slice(*entry[CODEC_ID])]).decode() if CODEC_ID in entry else ""
    duration = _number(data, *entry[DEFAULT_DURATION]) if DEFAULT_DURATION in entry else 0
    media.tracks[number] = {"type": _number(data, *entry[TRACK_TYPE]) if TRACK_TYPE in entry else 0, "codec": codec, "duration": duration}


def parse(data: bytes) -> Media:
    """The tables of a file; ValueError if it isn't a well-formed one."""
    view, media = memoryview(data), Media()
    at = 0
    while at < len(view):
        ident, body, _ = read_vint(view, at, True)
        size, body, _ = read_vint(view, body, False)
        end = len(view) if size < 0 else body + size
        if end > len(view):
            raise ValueError("truncated file")
        if ident == EBML:
            for x, _, a, b in elements(view, body, end):
                if x == DOC_TYPE:
                    media.doc_type = bytes(view[a:b]).decode()
        elif ident == SEGMENT:
            _segment(view, body, end, media)
        at = end
    if media.doc_type not in ("matroska", "webm"):
        raise ValueError("no Matroska header")
    return media


def _segment(data, origin: int, end: int, media: Media) -> None:
    at = origin
    while at < end:
        ident, start, a, b = next(elements(data, at, end))
        if ident == CLUSTER:
            media.clusters.append(start)
            b = _cluster(data, a, end if b < 0 else b, media)
        elif b < 0:
            raise ValueError("only segments and clusters may have unknown sizes")
        elif ident == INFO:
            for x, _, c, d in elements(data, a, b):
                if x == TIMESTAMP_SCALE:
                    media.scale = _number(data, c, d)
        elif ident == TRACKS:
            for x, _, c, d in elements(data, a, b):
                if x == TRACK_ENTRY:
                    _track(data, c, d, media)
        elif ident == CUES:
            for x, _, c, d in elements(data, a, b):
                if x == CUE_POINT:
                    _cue(data, c, d, media, origin)
        at = b


# --- writing -------------------------------------------------------------------------------------------------
def _lace(frames: list[bytes], turn: int) -> tuple[int, bytes]:
    """(lacing, lace header) of a block; the kinds take turns, fixed sizes only for equal frames."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0, b""
    kind = (3, 1, 2)[turn % 3]
    if kind == 2 and len(set(sizes)) > 1:
        kind = 3
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += write_size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            d = n - before
            length = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
            head += write_size(d + (1 << 7 * length - 1) - 1, length)
    return kind, head


def build(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples at 8 kHz: frames of 1,024 bytes, laced by eight, four blocks a cluster."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"signalspark") + element(WRITING_APP, b"signalspark"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, b"\x45\xfa\x00\x00") + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    step = FRAME * 1_000_000_000 // RATE
    entry = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, step) + audio
    parts, cues = [info, element(TRACKS, element(TRACK_ENTRY, entry))], []
    at = sum(map(len, parts))
    in_block, in_cluster = FRAME * FRAMES_PER_BLOCK, FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for start in range(0, len(payload), in_cluster):
        time = start * 1000 // RATE
        body = [unsigned(TIMESTAMP, time)]
        for k, b in enumerate(range(start, min(start + in_cluster, len(payload)), in_block)):
            chunk = payload[b : b + in_block]
            frames = [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)]
            kind, lace = _lace(frames, k)
            block = b"\x81" + (b * 1000 // RATE - time).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace + chunk
            body.append(element(SIMPLE_BLOCK, block))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# --- columns -------------------------------------------------------------------------------------------------
def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, packet, track, timestamp_ns, byte_offset, size, keyframe, lacing, cluster, error): a row per packet.

    A file that isn't well formed gives one row with its error, a null file none. Repeated rows give their
    packets again."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            ids = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                try:
                    found = [(k, *p, None) for k, p in enumerate(parse(m).packets)]
                except (ValueError, IndexError, KeyError) as e:
                    found = [(None,) * 8 + (str(e) or type(e).__name__,)]
                ids += [i] * len(found)
                for c, values in zip(cols, zip(*found, strict=True), strict=False):
                    c.extend(values)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            names = ["packet", "track", "timestamp_ns", "byte_offset", "size", "keyframe", "lacing", "cluster", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", *names])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(run, "id long, packet int, track long, timestamp_ns long, byte_offset long, size long, keyframe boolean, lacing int, cluster int, error string")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): texts as UTF-8, null as empty, padded with zero bytes to a positive multiple of 64.

    One row per input row, repeated rows too; null ids stay null. A very long text is one file, built whole in its task.
    Further columns are ignored, whatever their names. No rows: no result rows."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            media = [build(t + bytes(-len(t) % 64 or (0 if t else 64))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> digests of the payload as cut out of the packets, and a feature string.

    feature: packets, laced packets, clusters, cues that point at a cluster, duration in ms, codec. A null medium has null
    digests; equal media have equal ones, whatever their rows; a file without packets has an empty payload, and one that
    is not well formed is an error, as ``store`` makes none. Long media are read whole. Further columns are ignored. No rows: no
    result rows."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for m in b.column(2).to_pylist():
                if m is None:
                    out.append((None,) * 6)
                    continue
                media = parse(m)
                payload = b"".join([m[o : o + n] for _, _, o, n, _, _, _ in media.packets])
                good = sum(at in media.clusters for _, _, at in media.cues)
                last = media.packets[-1] if media.packets else None
                ms = last[1] // 1_000_000 + last[3] * 1000 // RATE if last else 0
                laced = sum(p[5] > 0 for p in media.packets)
                feature = f"packets={len(media.packets)};laced={laced};clusters={len(media.clusters)};cues={good};ms={ms};codec={media.tracks[last[0]]['codec'] if last else ''}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
