"""Fixed-size records of events and start times in binary fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The format's layout of an event, 112 bytes, and of a start time, 12 bytes, both little-endian.
EVENT = np.dtype(
    [("location", "<u2"), ("aux", "<u2"), ("group_type", "<u4"), ("start", "<f8"), ("span", "<f8"), ("score", "<u4"), ("creator", "i1"), ("pad", "V3"), ("name", "V78"), ("end", "V2")]
)
START = np.dtype([("year", "<u2"), ("month", "u1"), ("day", "u1"), ("hour", "u1"), ("minute", "u1"), ("second", "u1"), ("pad", "V1"), ("micros", "<u4")])


def _records(df: DataFrame, keys: list[str], data: str, layout: np.dtype, fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """(keys, n, fields): one row per record; a field whose length is no multiple of the record's is an error, null has none."""
    rows = df.select(*keys, data)
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "n long", *(f"{f} {kind}" for f, (kind, _) in fields.items())])

    def run(batches):
        for b in batches:
            values = b.column(b.num_columns - 1).to_pylist()
            for v in values:
                if v is not None and len(v) % layout.itemsize:
                    raise ValueError(f"{len(v)} bytes are no whole records of {layout.itemsize}")
            counts = [len(v or b"") // layout.itemsize for v in values]
            at = pa.array(np.repeat(np.arange(len(values)), counts))
            got = np.frombuffer(b"".join(v or b"" for v in values), layout)
            n = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
            columns = [c.take(at) for c in b.columns[:-1]] + [pa.array(n, pa.int64())]
            for f, (_, arrow) in fields.items():
                if layout[f].kind == "V":
                    columns.append(pa.array([bytes(x).decode("utf-16-le").split("\0", 1)[0] for x in got[f]], arrow))
                else:
                    columns.append(pa.array(got[f].astype("f8" if layout[f].kind == "f" else "i8"), arrow))
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n", *fields])

    return rows.mapInArrow(run, schema)


def event_records(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """(keys, n, location, aux, group_type, start, span, score, creator, name) of a binary field of events."""
    number = ("long", pa.int64())
    real = ("double", pa.float64())
    fields = {"location": number, "aux": number, "group_type": number, "start": real, "span": real, "score": number, "creator": number, "name": ("string", pa.string())}
    return _records(df, keys, data, EVENT, fields)


def start_times(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """(keys, n, t): times without zone of a binary field of start times; null for one that is no date."""
    parts = ("year", "month", "day", "hour", "minute", "second", "micros")
    out = _records(df, keys, data, START, dict.fromkeys(parts, ("long", pa.int64())))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%06d", *parts)
    return out.withColumn("text", text).select(*keys, "n", F.expr("try_cast(text as timestamp_ntz)").alias("t"))
