"""Container trees in binary files as a table: one row per entry with its path in the tree.

Heads of entries are read and payloads seeked over; only the payloads of rows that filters on ``name`` and ``type`` leave are read."""

from __future__ import annotations

import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from signalspark.sources.storage import Wanted, files, open_read

#: Type codes of entries.
TYPES = {
    0: "any", 1: "rectangle", 2: "point", 3: "string", 4: "bool", 5: "byte", 6: "word", 7: "dword", 8: "long", 9: "float", 10: "double", 11: "adouble",
    12: "reference", 13: "parcel", 14: "time", 15: "timespan", 16: "void", 17: "action", 18: "specifier", 19: "aword", 20: "abyte",
    1000: "resend", 2000: "events", 2001: "evsttime",
}
PARCEL = 13
NUMBERS = {"word": "<H", "dword": "<I", "long": "<i", "float": "<f", "double": "<d", "byte": "<B"}


def walk(f, start: int = 0, place: str = "/"):
    """(place of the container, depth-first number in it, name, type, offset, size) of all entries below a container.

    Containers inside are told before what they hold. A container whose entries do not fill its size is an error."""
    f.seek(start)
    _, size, _ = struct.unpack("<HIH", f.read(8))
    at, n = start + 8, 0
    while at < start + size:
        f.seek(at)
        head = f.read(12)
        if len(head) < 12:
            break
        whole, held, kind = struct.unpack("<iiH", head[:10])
        if held < 0 or whole < held + 12:
            raise ValueError(f"entry at {at} of sizes {whole} and {held}")
        f.seek(at + 12 + held)
        name = f.read(whole - held - 12).decode("latin-1").strip("\0")
        kind = TYPES.get(kind, "any")
        yield place, n, name, kind, at + 12, held
        if kind == "parcel":
            yield from walk(f, at + 12, f"{place}{name}/")
        at, n = at + whole, n + 1
    if at != start + size:
        raise ValueError(f"container at {start} says {size} bytes and has {at - start}")


def text_of(kind: str, data: bytes) -> str | None:
    """A value as text; null for types without one."""
    if kind == "string":
        return data.decode("cp1252").strip("\0")
    if kind == "bool":
        return str(any(data)).lower()
    if kind in NUMBERS:
        return str(struct.unpack(NUMBERS[kind], data[: struct.calcsize(NUMBERS[kind])])[0])
    if kind == "timespan":
        seconds = struct.unpack_from("<q", data)[0]
        return str(float(seconds) + (struct.unpack_from("<i", data, 8)[0] / 1000 if len(data) == 16 else 0.0))
    return None


class ContainerReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.wanted = options["path"], Wanted()

    def pushFilters(self, filters):
        self.wanted = Wanted(filters)
        return filters

    def partitions(self):
        return [InputPartition(p) for p in files(self.path) if self.wanted.takes("path", p)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        with open_read(partition.value) as f:
            for place, n, name, kind, at, size in walk(f):
                if not (self.wanted.takes("name", name) and self.wanted.takes("type", kind)):
                    continue
                data = None
                if kind != "parcel":
                    f.seek(at)
                    data = f.read(size)
                yield partition.value, place, n, name, kind, at, size, None if data is None else text_of(kind, data), data


class ContainerSource(DataSource):
    """``place`` is the path of the container that holds the entry, ``n`` its number there."""

    @classmethod
    def name(cls):
        return "container"

    def schema(self):
        return "path string, place string, n long, name string, type string, offset long, size long, value string, data binary"

    def reader(self, schema):
        return ContainerReader(self.options)
