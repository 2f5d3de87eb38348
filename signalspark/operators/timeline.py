"""Recordings as sequences of samples with gaps between: numbers, times and access by time.

A table of sequences has (keys, seq, start, n): one row per uninterrupted stretch, its first time in seconds and how many
samples it holds. Samples have (keys, seq, k, x), k counted from 0 within the sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.joins import asof_join
from signalspark.operators.segment import sample_hold

#: Slack for sums of seconds that should fall on a sample.
EPS = 1e-9


def sequences(samples: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, start, n) of samples and the starts (keys, seq, start)."""
    return samples.groupBy(*keys, "seq").agg(F.count("*").alias("n")).join(starts, [*keys, "seq"]).select(*keys, "seq", "start", "n")


def numbered(seqs: DataFrame, keys: list[str], srate: float) -> DataFrame:
    """Sequences with ``first`` (place of their first sample in the recording), ``stop`` and ``duration`` in seconds.

    Only sequences are ordered here, never samples."""
    w = Window.partitionBy(*keys).orderBy("start", "seq")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = seqs.withColumn("first", before).withColumn("duration", F.col("n") / F.lit(srate))
    return out.withColumn("stop", F.col("start") + F.col("duration"))


def sample_times(samples: DataFrame, seqs: DataFrame, keys: list[str], srate: float) -> DataFrame:
    """Samples with ``index`` (place in the recording) and ``t``."""
    heads = numbered(seqs, keys, srate).select(*keys, "seq", "start", "first")
    out = samples.join(heads, [*keys, "seq"])
    return out.withColumn("index", F.col("first") + F.col("k")).withColumn("t", F.col("start") + F.col("k") / F.lit(srate)).drop("start", "first")


def locate(times: DataFrame, seqs: DataFrame, keys: list[str], srate: float, t: str = "t") -> DataFrame:
    """Times with the ``seq``, ``k`` and ``index`` of the sample that holds there; null before the start and in gaps."""
    heads = numbered(seqs, keys, srate).withColumn(t, F.col("start"))
    out = asof_join(times, heads, t, keys, ["seq", "start", "first", "n"])
    k = F.floor((F.col(t) - F.col("start")) * srate + EPS)
    inside = k < F.col("n")
    out = out.withColumn("k", F.when(inside, k)).withColumn("seq", F.when(inside, F.col("seq")))
    return out.withColumn("index", F.col("first") + F.col("k")).drop("start", "first", "n")


def times_of(places: DataFrame, seqs: DataFrame, keys: list[str], srate: float, index: str = "index") -> DataFrame:
    """Places in the recording with ``seq``, ``k`` and ``t``; null beyond the last sample."""
    heads = numbered(seqs, keys, srate).where("n > 0").withColumn(index, F.col("first"))
    out = asof_join(places, heads, index, keys, ["seq", "start", "first", "n"])
    k = F.col(index) - F.col("first")
    inside = k < F.col("n")
    out = out.withColumn("k", F.when(inside, k)).withColumn("seq", F.when(inside, F.col("seq")))
    return out.withColumn("t", F.col("start") + F.col("k") / F.lit(srate)).drop("start", "first", "n")


def values_at(times: DataFrame, samples: DataFrame, seqs: DataFrame, keys: list[str], srate: float, default: float = 0.0, value: str = "x", t: str = "t") -> DataFrame:
    """Times with the sample that holds there, ``default`` outside the sequences."""
    found = locate(times, seqs, keys, srate, t)
    held = samples.select(*keys, "seq", "k", value)
    return found.join(held, [*keys, "seq", "k"], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def range_scan(samples: DataFrame, seqs: DataFrame, keys: list[str], srate: float, start: float, stop: float, default: float = 0.0, factor: int = 1, value: str = "x") -> DataFrame:
    """(keys, i, t, <value>): the samples of [start, stop) on a regular grid from ``start`` on, cut to the recording.

    Gaps read ``default``; ``factor`` repeats every sample that often (i and t then count the repeats). Each sample is sent
    to the one grid place from which it holds, so grid and samples meet in one equi-join."""
    step = 1.0 / srate
    ends = numbered(seqs, keys, srate).groupBy(*keys).agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    low = F.greatest(F.lit(0), F.ceil((F.col("a") - start) * srate - EPS))
    high = F.ceil((F.least(F.lit(float(stop)), F.col("b")) - start) * srate - EPS) - 1
    grid = ends.select(*keys, low.alias("low"), high.alias("high")).where("high >= low").select(*keys, F.explode(F.sequence("low", "high")).alias("i"))
    near = seqs.where((F.col("start") < stop) & (F.col("start") + F.col("n") * step > start)).select(*keys, "seq", "start")
    place = F.ceil((F.col("start") - start) * srate - EPS) + F.col("k")
    held = samples.join(near, [*keys, "seq"]).select(*keys, place.alias("i"), value)
    out = grid.join(held, [*keys, "i"], "left").withColumn(value, F.coalesce(value, F.lit(default)))
    if factor > 1:
        out = sample_hold(out, factor)
    return out.select(*keys, "i", (F.col("i") * F.lit(step / factor) + F.lit(float(start))).alias("t"), value)


def crop_centred(df: DataFrame, keys: list[str], width: float, t: str = "t") -> DataFrame:
    """Rows of the ``width`` seconds around the middle of each recording, the end left out."""
    ends = df.groupBy(*(F.col(k).alias(f"{k} of") for k in keys)).agg(((F.min(t) + F.max(t)) / 2).alias("middle"))
    on = [df[k].eqNullSafe(ends[f"{k} of"]) for k in keys]
    inside = (F.col(t) >= F.col("middle") - width / 2) & (F.col(t) < F.col("middle") + width / 2)
    return df.join(ends, on).where(inside).drop("middle", *(f"{k} of" for k in keys))


def annotations(events: DataFrame, names: dict[str, int], srate: float, sample: str = "sample", code: str = "code") -> DataFrame:
    """Events with ``onset`` in seconds, ``duration`` 0 and ``description``, the name of their code; unknown codes keep the number."""
    pairs = [F.lit(v) for name, number in sorted(names.items(), key=lambda p: p[1]) for v in (number, name)]
    known = F.try_element_at(F.create_map(*pairs), F.col(code)) if pairs else F.lit(None).cast("string")
    out = events.withColumn("onset", F.col(sample) / F.lit(srate)).withColumn("duration", F.lit(0.0))
    return out.withColumn("description", F.coalesce(known, F.col(code).cast("string")))


def marker_annotations(df: DataFrame, markers: str, srate: float) -> DataFrame:
    """One row (.., onset, duration, description) per positive value of an array of markers."""
    rest = [c for c in df.columns if c != markers]
    out = df.select(*rest, F.posexplode(markers).alias("place", "marker")).where("marker > 0")
    return out.select(*rest, (F.col("place") / F.lit(srate)).alias("onset"), F.lit(0.0).alias("duration"), F.col("marker").cast("string").alias("description"))


def stamp_parts(seconds: str) -> tuple:
    """The date (dd.mm.yy) and the time (hh.mm.ss) that a recording's header carries, of seconds since 1970 in UTC."""
    at = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(floor({seconds}) as decimal(18,6)))")
    return F.date_format(at, "dd.MM.yy"), F.date_format(at, "HH.mm.ss")


def replaced_or(text: str, void: str, old: str, new: str):
    """The text with ``old`` replaced; ``void`` where it is empty. Null stays null."""
    return F.when(F.col(text) == "", F.lit(void)).otherwise(F.replace(F.col(text), F.lit(old), F.lit(new)))


def token_offsets(df: DataFrame, keys: list[str], text: str, token: str) -> DataFrame:
    """(keys, n, place): where each occurrence of ``token`` starts, in characters from 0, occurrences apart.

    Only the lengths of the parts between occurrences are ordered, not the text. ``keys`` must tell rows apart."""
    if not token:
        raise ValueError("an empty token occurs everywhere")
    quoted = "\\Q" + token.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = df.select(*keys, F.posexplode(F.transform(F.split(text, quoted, -1), F.length)).alias("n", "length"))
    w = Window.partitionBy(*keys).orderBy("n")
    place = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n") * len(token)
    return parts.withColumn("place", place).withColumn("more", F.lead("n").over(w)).where("more is not null").select(*keys, "n", "place")
