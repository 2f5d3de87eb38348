"""The flagship feature table: one row per epoch and channel, one column per feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.functions import kernels as kn
from signalspark.functions import nonlinear as nl
from signalspark.functions import spectral as sp
from signalspark.schema import FeatureSpec

#: Outputs of the kernels of the families that need one.
PARAMETERS = {"offset": "PeakFitOffset", "exponent": "PeakFitExponent", "r2": "PeakFitR2", "cf_0": "CF_0", "pw_0": "PW_0", "bw_0": "BW_0", "cf_1": "CF_1", "pw_1": "PW_1", "bw_1": "BW_1"}
IRASA = {"offset": "IrasaOffset", "slope": "IrasaSlope", "r2": "IrasaR2", "osc_area": "IrasaOscArea", "osc_std": "IrasaOscStd"}
CANONICAL = ("mode_5", "mode_10", "acf_timescale", "acf_first_min", "trev", "high_fluctuation", "stretch_high", "stretch_decreasing", "forecast_error", "centroid_freq", "low_freq_power")


def _kernel(families: set[str], srate: float, segment: int, low: float, high: float):
    """The function of a block of epochs that gives all spectra and features of the families, and its schema."""
    names = {"psd of epoch": "array<double>"} if {"psd", "aperiodic"} & families else {}
    if "complexity" in families:
        names |= dict.fromkeys(("SampleEntropy", "LempelZiv", "DFA"), "double")
    if "parameterised" in families:
        names |= dict.fromkeys(PARAMETERS.values(), "double")
    if "irasa" in families:
        names |= dict.fromkeys(IRASA.values(), "double")
    if "canonical" in families:
        names |= dict.fromkeys(CANONICAL, "double")

    def run(x):
        out = {}
        if {"psd", "aperiodic", "parameterised"} & families:
            f, p = kn.welch(x, srate, segment)
            out["psd of epoch"] = p
        if "complexity" in families:
            out |= {"SampleEntropy": kn.sample_entropy(x), "LempelZiv": kn.lempel_ziv_normalised(x), "DFA": kn.epoch_dfa(x)}
        if "parameterised" in families:
            keep = (f >= low) & (f <= high)
            got = kn.peaks_and_slope(p[:, keep], f[keep])
            out |= {new: got[old] for old, new in PARAMETERS.items()}
        if "irasa" in families:
            got = kn.irasa(x, srate, max(16, segment // 2), low, min(high, srate / 4))
            out |= {new: got[old] for old, new in IRASA.items()}
        if "canonical" in families:
            got = kn.canonical_features(x)
            out |= {n: got[n] for n in CANONICAL}
        return out

    return run, names


def generate_features(epochs: DataFrame, keys: list[str], srate: float, samples: int, spec: FeatureSpec | None = None, value: str = "x") -> DataFrame:
    """Features of epochs of ``samples`` values each.

    Spectra are Welch's, of half-overlapping segments of one second. What needs an FFT or a kernel comes from one pass over
    Arrow batches in the scan's stage, the rest from expressions on the epoch's array: nothing is shuffled, and families that
    are not asked for are never computed. Column names follow from the spec alone; a null or empty epoch has null features."""
    spec = spec or FeatureSpec()
    families = set(spec.families)
    segment = max(2, min(samples, round(srate)))
    step, x, p = srate / segment, F.col(value), F.col("psd of epoch")
    high = min(max(b[1] for b in spec.bands), srate / 2)
    low = min(b[0] for b in spec.bands)
    df = epochs.select(*keys, value)
    columns = []
    kernel, names = _kernel(families, srate, segment, low, min(high, srate / 2 - step))
    if names:
        df = kn.map_epochs(df, [*keys, value], kernel, ", ".join(f"`{n}` {t}" for n, t in names.items()), value)
    if "psd" in spec.families:
        whole = sp.band_power(p, step, low, high) if spec.relative else F.lit(1.0)
        columns += [F.try_divide(sp.band_power(p, step, a, b), whole).alias(f"{n}_PSD") for a, b, n in spec.bands]
        columns += [F.log10(sp.band_power(p, step, low, high)).alias("TotalAbsPow"), sp.spectral_edge(sp.crop(p, step, low, high)).alias("SpectralEdge")]
    if "aperiodic" in spec.families:
        df = df.withColumn("fit of epoch", sp.trimmed_log_fit(p, step, low, min(high, srate / 2 - step)))
        columns += [F.col("fit of epoch.intercept").alias("Offset"), (-F.col("fit of epoch.slope")).alias("Exponent"), F.col("fit of epoch.r2").alias("FitR2")]
    if "nonlinear" in spec.families:
        measures = {"PermEntropy": nl.permutation_entropy, "SVDEntropy": nl.svd_entropy, "PetrosianFD": nl.petrosian_fd, "KatzFD": nl.katz_fd, "HiguchiFD": nl.higuchi_fd, "PLZC": nl.pattern_complexity}
        columns += [f(x).alias(n) for n, f in measures.items()]
    if "acw" in spec.families:
        columns.append(nl.acw(x, srate).alias("ACW"))
    if "hjorth" in spec.families:
        df = df.withColumn("hjorth of epoch", nl.hjorth(x))
        columns += [F.col(f"hjorth of epoch.{k}").alias(k.title()) for k in ("activity", "mobility", "complexity")]
    columns += [F.col(n) for n in names if n != "psd of epoch"]
    return df.select(*keys, *columns)
