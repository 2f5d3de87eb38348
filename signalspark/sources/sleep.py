"""Recorder conventions: calibration, channel types, sleep-stage names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of sleep stages.
STAGES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "R": 4}

#: Channel types looked for in a label, in order.
TYPES = ["EEG", "EOG", "ECG", "EMG", "RESP", "SPO2", "TEMP"]


def stage_code(name: Column) -> Column:
    """Code of a sleep-stage event name, null for other events. Replacements are made in order."""
    stage = F.replace(name, F.lit("SLEEP-"), F.lit(""))
    for a, b in (("S0", "W"), ("REM", "R"), ("S", "N")):
        stage = F.replace(stage, F.lit(a), F.lit(b))
    code = F.lit(None).cast("int")
    for k, v in STAGES.items():
        code = F.when(stage == k, v).otherwise(code)
    return F.when(F.contains(name, F.lit("SLEEP")), code)


def channel_type(label: Column) -> Column:
    """Type of a channel by its label: EKG is ECG, what fits nothing is MISC."""
    upper = F.replace(F.upper(label), F.lit("EKG"), F.lit("ECG"))
    out = F.lit("MISC")
    for t in reversed(TYPES):
        out = F.when(F.contains(upper, F.lit(t)), t).otherwise(out)
    return out


def clamp(raw: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def from_raw(raw: Column, scale: float, offset: float) -> Column:
    return raw * F.lit(float(scale)) + F.lit(float(offset))


def to_raw(value: Column, scale: float, offset: float) -> Column:
    return F.floor((value - F.lit(float(offset))) / F.lit(float(scale)) + 0.5).cast("long")


def parse_calibration(text: str) -> tuple[float, float]:
    """(scale, offset) of a text such as '0.5*x-3'; anything else is an error and is never evaluated."""
    number = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    m = re.fullmatch(rf"\s*(?:({number})\s*\*\s*)?x\s*(?:([+-])\s*({number}))?\s*", text)
    if not m:
        raise ValueError(f"not a linear calibration: {text!r}")
    return float(m[1] or 1), float((m[2] or "+") + m[3].lstrip("+")) if m[3] else 0.0
