"""Schemas, bands and feature names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The default frequency bands in Hz, inclusive at both ends; they overlap.
BANDS = [
    (1.0, 4.0, "Delta"),
    (4.0, 8.0, "Theta"),
    (6.0, 10.0, "ThetaAlpha"),
    (8.0, 12.0, "Alpha"),
    (12.0, 18.0, "Beta1"),
    (18.0, 30.0, "Beta2"),
    (30.0, 40.0, "Gamma1"),
]

FAMILIES = ("psd", "aperiodic", "nonlinear", "acw", "hjorth")
#: Families that are computed where they are asked for.
FURTHER = ("complexity", "parameterised", "irasa", "canonical")

EPOCHS = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("chan", T.StringType()),
        T.StructField("srate", T.DoubleType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)


@dataclass(frozen=True)
class FeatureSpec:
    """Which families and bands a feature table has; columns follow from it."""

    families: tuple[str, ...] = FAMILIES
    bands: tuple[tuple[float, float, str], ...] = tuple(BANDS)
    relative: bool = True

    def __post_init__(self):
        unknown = set(self.families) - {*FAMILIES, *FURTHER}
        if unknown:
            raise ValueError(f"unknown feature families: {sorted(unknown)}")

    @property
    def band_names(self) -> list[str]:
        return [b[2] for b in self.bands]
