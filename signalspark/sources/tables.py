"""Scans and sinks on plain files: parquet recordings, BESS text, positions, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.schema import EPOCHS


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of epochs with the fixed schema."""
    return spark.read.schema(EPOCHS).parquet(path)


def from_arrays(df: DataFrame, epoch: str, channels: list[str], srate: float, recording: str = "r") -> DataFrame:
    """A table with one array column per channel as epochs; the layout is given, never guessed."""
    parts = F.array(*(F.struct(F.lit(c).alias("chan"), F.col(c).cast("array<double>").alias("x")) for c in channels))
    rows = df.select(F.col(epoch).cast("long").alias("epoch"), F.explode(parts).alias("p"))
    return rows.select(F.lit(recording).alias("recording_id"), "epoch", "p.chan", F.lit(float(srate)).alias("srate"), "p.x")


def read_bess(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, samples) of text exports: header (path, srate, channels), samples (path, i, t, chan, x).

    One row per file is parsed by expressions: the text before '(' in channel lines names the channels, tab
    separated numbers are the samples, one line per time."""
    lines = F.transform(F.split("value", "\r?\n"), lambda v: F.trim(v))
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), lines.alias("lines"))
    files = files.where(F.exists("lines", lambda v: F.contains(v, F.lit("BESS Text Export"))))
    number = r"^[-+0-9.eE]+(\t[-+0-9.eE]+)*$"
    rate = F.filter("lines", lambda v: v.startswith("SamplingRate"))
    chans = F.transform(F.filter("lines", lambda v: v.rlike(r"^[^=\t]+\(.*\)")), lambda v: F.trim(F.substring_index(v, "(", 1)))
    header = files.select("path", F.regexp_extract(F.get(rate, 0), r"SamplingRate\s*=\s*([0-9.]+)", 1).cast("double").alias("srate"), chans.alias("channels"), "lines")
    rows = F.filter("lines", lambda v: v.rlike(number))
    values = F.posexplode(F.transform(rows, lambda v: F.split(v, "\t"))).alias("i", "cells")
    samples = header.select("path", "srate", "channels", values).select("path", "srate", "channels", "i", F.posexplode("cells").alias("c", "cell"))
    chan = F.coalesce(F.get("channels", F.col("c")), F.concat(F.lit("ch"), F.col("c").cast("string")))
    samples = samples.select("path", F.col("i").cast("long").alias("i"), (F.col("i") / F.col("srate")).alias("t"), chan.alias("chan"), F.col("cell").cast("double").alias("x"))
    return header.drop("lines"), samples


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(chan, x, y, z) in metres, axes turned to right-anterior; positions in mm are told by their size."""
    p = spark.read.csv(path, header=True, schema="X double, Y double, Z double, channels string")
    far = p.agg(F.max(F.sqrt(F.col("X") ** 2 + F.col("Y") ** 2 + F.col("Z") ** 2))).first()[0] or 0.0
    scale = 0.001 if far > 10 else 1.0
    return p.select(F.col("channels").alias("chan"), (-F.col("Y") * scale).alias("x"), (F.col("X") * scale).alias("y"), (F.col("Z") * scale).alias("z"))


def adjacency(positions: DataFrame, radius: float) -> DataFrame:
    """(a, b, d) of channels within ``radius``, both directions; cells of that size limit what is compared."""
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    p = positions.select("chan", "x", "y", "z", *cell)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    near = p.withColumn("s", F.explode(steps)).select(F.col("chan").alias("a"), *(F.col(c).alias(f"{c}a") for c in "xyz"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), (F.col("cz") + F.col("s.k")).alias("cz"))
    both = near.join(p, ["cx", "cy", "cz"]).where("a <> chan")
    d = F.sqrt(sum(((F.col(f"{c}a") - F.col(c)) ** 2 for c in "yz"), (F.col("xa") - F.col("x")) ** 2))
    return both.select("a", F.col("chan").alias("b"), d.alias("d")).where(F.col("d") <= radius)


def standardise(channels: DataFrame, montage: DataFrame, name: str = "chan") -> tuple[DataFrame, DataFrame]:
    """(known, unknown) channels: names matched to the montage's whatever their case."""
    m = montage.select(F.col("chan").alias("standard"), *(c for c in montage.columns if c != "chan"))
    on = F.lower(F.col(name)) == F.lower(F.col("standard"))
    return channels.join(m, on), channels.join(m, on, "left_anti")


def lead_matrix(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (a, b, g) of a reference matrix for the given labels (label), case aside; an unknown label is an error."""
    want = labels.select("label", F.lower("label").alias("low")).distinct()
    known = pairs.select(F.lower("a").alias("low")).distinct()
    missing = [r["label"] for r in want.join(known, "low", "left_anti").orderBy("label").limit(5).collect()]
    if missing:
        raise ValueError(f"no reference for {missing}")
    a, b = want.select(F.col("label").alias("la"), F.col("low").alias("xa")), want.select(F.col("label").alias("lb"), F.col("low").alias("xb"))
    return pairs.join(a, F.lower("a") == F.col("xa")).join(b, F.lower("b") == F.col("xb")).select(F.col("la").alias("a"), F.col("lb").alias("b"), "g")


def write_clean(df: DataFrame, base: str, version: int | None = None) -> str:
    """Parquet under '<base>_clean[_NN]'; returns the path."""
    path = f"{base}_clean" + (f"_{version:02d}" if version is not None else "")
    df.write.mode("overwrite").parquet(path)
    return path


def append_log(spark: SparkSession, path: str, **fields: object) -> None:
    """Adds a row to a CSV run log."""
    names = list(fields)
    row = spark.range(1).select(*(F.lit(fields[n]).cast("string").alias(n) for n in names))
    row.write.mode("append").option("header", True).csv(path)


def sine(spark: SparkSession, freq: float, amplitude: float, srate: float, seconds: float, phase: float = 0.0) -> DataFrame:
    """(i, t, x): a sine with both ends of the time axis included."""
    import math

    n = int(srate * seconds)
    t = F.col("id") * F.lit(seconds / max(1, n - 1))
    return spark.range(n).select(F.col("id").alias("i"), t.alias("t"), (amplitude * F.sin(2 * math.pi * freq * t + math.radians(phase))).alias("x"))


def pink_noise(spark: SparkSession, n: int, levels: int = 16, seed: int = 0) -> DataFrame:
    """(i, x): sum of random values that are renewed every 2**level samples; any row can be made on its own."""
    i = F.col("id")
    held = [F.pmod(F.xxhash64(F.shiftright(i, level), F.lit(level), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5 for level in range(levels)]
    return spark.range(n).select(i.alias("i"), sum(held[1:], held[0]).alias("x"))
