"""Array kernels for what columns cannot express: long transforms, recursive filters, iterative fits.

Each works on a block (epochs x samples) of equal length. ``map_epochs`` brings them to a DataFrame: Arrow
batches go straight from the scan to the kernel, nothing is shuffled, and a task holds one batch at a time, of which a kernel
sees ``BLOCK`` samples at once, as kernels need many times the room of their samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Samples that a kernel is given at once, but whole epochs.
BLOCK = 1 << 14


def map_epochs(df: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, value: str = "x") -> DataFrame:
    """(keys, <schema>) for each row. ``kernel`` takes a block and returns columns; null or empty arrays give nulls.

    Rows of a batch are grouped by length, so epochs of several lengths may come mixed; a kernel gets some of them at a time."""
    rows = df.select(*keys, F.col(value).cast("array<double>").alias("signal of row"))
    fields = T._parse_datatype_string(schema).fields
    out = T.StructType([*rows.drop("signal of row").schema.fields, *fields])
    names = [f.name for f in fields]

    def run(batches):
        for b in batches:
            signals = b.column(b.num_columns - 1)
            starts = signals.offsets.to_numpy()
            flat = signals.values.to_numpy(zero_copy_only=False)  # nulls as NaN
            sizes = np.where(signals.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
            cols = {n: [None] * len(sizes) for n in names}
            for size in np.unique(sizes[sizes > 0]).tolist():
                of_size, some = np.flatnonzero(sizes == size), max(1, BLOCK // size)
                for at in (of_size[k : k + some] for k in range(0, len(of_size), some)):
                    got = kernel(flat[starts[at][:, None] + np.arange(size)])
                    for n in names:
                        for i, v in zip(at.tolist(), got[n], strict=True):
                            cols[n][i] = v if isinstance(v, np.ndarray) else None if v != v else v.item() if hasattr(v, "item") else v
            types = [pa.list_(pa.float64()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in fields]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(cols[n], t) for n, t in zip(names, types, strict=True))], [*b.schema.names[:-1], *names])

    return rows.mapInArrow(run, out)


# --- spectra -------------------------------------------------------------------------------------------------
def welch(x: np.ndarray, srate: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided densities: half-overlapping Hamming segments, mean removed, median over segments
    with its bias corrected."""
    size = min(size, x.shape[1])
    hop = size - size // 2
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, x.shape[1] - size + 1, hop)
    seg = np.stack([x[:, s : s + size] for s in starts], axis=1)
    seg = (seg - seg.mean(axis=2, keepdims=True)) * window
    p = np.abs(np.fft.rfft(seg, axis=2)) ** 2 / (srate * (window**2).sum())
    p[..., 1 : -1 if size % 2 == 0 else None] *= 2
    n = seg.shape[1]
    bias = 1 + sum(1 / (2 * i + 1) - 1 / (2 * i) for i in range(1, (n - 1) // 2 + 1))
    return np.fft.rfftfreq(size, 1 / srate), np.median(p, axis=1) / bias


def multitaper(x: np.ndarray, srate: float, tapers: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean spectrum over sine tapers."""
    n = x.shape[1]
    t = np.arange(1, n + 1) * np.pi / (n + 1)
    total = 0
    for k in range(1, tapers + 1):
        total = total + np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.sqrt(2 / (n + 1)) * np.sin(k * t), axis=1)) ** 2
    p = total / tapers / srate
    p[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / srate), p


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling by a windowed-sinc filter (Kaiser, beta 5); zeros beyond the ends."""
    rate = max(up, down)
    half = 10 * rate
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / rate) / rate * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = x.shape[1]
    wide = np.zeros((x.shape[0], n * up))
    wide[:, ::up] = x
    size = 1 << int(np.ceil(np.log2(wide.shape[1] + len(taps))))
    full = np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(taps, size), size)
    out = -(-n * up // down)
    return full[:, half : half + wide.shape[1]][:, ::down][:, :out]


def irasa(x: np.ndarray, srate: float, size: int, low: float, high: float) -> dict[str, np.ndarray]:
    """Aperiodic offset, slope, fit and oscillatory area by irregular resampling with 17 factors 1.1 .. 1.9.

    Spectra of up- and downsampled signals are combined bin by bin by their geometric mean and the median over
    factors is taken as aperiodic; its line is fitted in ln-ln with the slope held in [-10, 2]."""
    f, whole = welch(x, srate, size)
    means = []
    for k in range(17):
        up, down = 22 + k, 20
        a, b = welch(resample(x, up, down), srate * up / down, size)[1], welch(resample(x, down, up), srate * down / up, size)[1]
        m = min(a.shape[1], b.shape[1], whole.shape[1])
        means.append(np.sqrt(a[:, :m] * b[:, :m]))
    m = min(p.shape[1] for p in means)
    aper = np.median(np.stack([p[:, :m] for p in means]), axis=0)
    keep = (f[:m] >= low) & (f[:m] <= high)
    lf, la = np.log(f[:m][keep]), np.log(np.maximum(aper[:, keep], 1e-300))
    centred = lf - lf.mean()
    slope = np.clip((la * centred).sum(axis=1) / (centred**2).sum(), -10, 2)
    offset = la.mean(axis=1) - slope * lf.mean()
    resid = la - offset[:, None] - slope[:, None] * lf
    r2 = 1 - (resid**2).sum(axis=1) / np.maximum(((la - la.mean(axis=1, keepdims=True)) ** 2).sum(axis=1), 1e-300)
    osc = whole[:, :m][:, keep] - aper[:, keep]
    return {"offset": offset, "slope": slope, "r2": r2, "osc_area": osc.sum(axis=1), "osc_std": osc.std(axis=1, ddof=1)}


def peaks_and_slope(p: np.ndarray, f: np.ndarray, peaks: int = 2, threshold: float = 2.0) -> dict[str, np.ndarray]:
    """Parameterised spectra: a robust line in log-log, then Gaussians at the largest residuals.

    Each round takes the largest residual above ``threshold`` deviations, sizes a Gaussian by its half height
    and subtracts it; the line is fitted again to what is left. Missing peaks are 0."""
    lf, lp = np.log10(f), np.log10(np.maximum(p, 1e-20))
    design = np.stack([np.ones_like(lf), lf], axis=1)

    def line(y, keep=None):
        if keep is None:
            return np.linalg.lstsq(design, y, rcond=None)[0]
        return np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]

    rows = {k: [] for k in ("offset", "exponent", "error", "r2", *(f"{a}_{k}" for k in range(peaks) for a in ("cf", "pw", "bw")))}
    for y in lp:
        first = y - design @ line(y)
        coef = line(y, first <= np.quantile(np.maximum(first, 0), 0.8)) if (first <= np.quantile(np.maximum(first, 0), 0.8)).sum() > 4 else line(y)
        flat, found = y - design @ coef, []
        for _ in range(peaks):
            at = int(flat.argmax())
            height = flat[at]
            if height <= threshold * flat.std():
                break
            below = np.flatnonzero(flat < height / 2)
            left = below[below < at].max(initial=-1)
            right = below[below > at].min(initial=len(f))
            sides = [d for d in (at - left if left >= 0 else None, right - at if right < len(f) else None) if d]
            sigma = max(min(sides, default=1), 1) * (f[1] - f[0]) / 1.1774
            found.append((f[at], height, 2 * sigma))
            flat = flat - height * np.exp(-((f - f[at]) ** 2) / (2 * sigma**2))
        bumps = sum((h * np.exp(-((f - c) ** 2) / (2 * (w / 2) ** 2)) for c, h, w in found), np.zeros_like(f))
        coef = line(y - bumps)
        model = design @ coef + bumps
        rows["offset"].append(coef[0])
        rows["exponent"].append(-coef[1])
        rows["error"].append(np.abs(y - model).mean())
        rows["r2"].append(np.corrcoef(y, model)[0, 1] ** 2)
        for k in range(peaks):
            c, h, w = found[k] if k < len(found) else (0.0, 0.0, 0.0)
            rows[f"cf_{k}"].append(c)
            rows[f"pw_{k}"].append(h)
            rows[f"bw_{k}"].append(w)
    return {k: np.array(v) for k, v in rows.items()}


# --- filters -------------------------------------------------------------------------------------------------
def band_pass(x: np.ndarray, srate: float, low: float | None, high: float | None, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth response applied in frequency, as forward and backward filtering has it; the ends are
    reflected."""
    pad = min(x.shape[1] - 1, int(3 * srate))
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad > 0 else x
    f = np.fft.rfftfreq(wide.shape[1], 1 / srate)
    warp = lambda v: np.tan(np.pi * np.minimum(v, srate / 2 * (1 - 1e-9)) / srate)
    w = np.maximum(warp(f), 1e-12)
    if low and high:
        shift = (w * w - warp(low) * warp(high)) / (w * (warp(high) - warp(low)))
    else:
        shift = w / warp(high) if high else warp(low) / w
    gain = 1 / (1 + np.minimum(np.abs(shift), 1e9) ** (2 * order))
    out = np.fft.irfft(np.fft.rfft(wide, axis=1) * gain, wide.shape[1], axis=1)
    return out[:, pad : pad + x.shape[1]] if pad > 0 else out


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal."""
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def envelope(x: np.ndarray, srate: float, low: float, high: float) -> np.ndarray:
    """Power envelope of a band."""
    return np.abs(analytic(band_pass(x, srate, low, high))) ** 2


def phase_amplitude(x: np.ndarray, srate: float, slow: tuple[float, float], fast: tuple[float, float]) -> np.ndarray:
    """Normalised direct coupling of a slow phase with a fast amplitude."""
    phase = np.angle(analytic(band_pass(x, srate, *slow)))
    amp = np.abs(analytic(band_pass(x, srate, *fast)))
    amp = (amp - amp.mean(axis=1, keepdims=True)) / np.maximum(amp.std(axis=1, keepdims=True), 1e-12)
    return np.abs((amp * np.exp(1j * phase)).mean(axis=1))


# --- complexity ----------------------------------------------------------------------------------------------
def sample_entropy(x: np.ndarray, r: float = 0.2) -> np.ndarray:
    """m = 2, tolerance r deviations, strict; NaN where no triple matches, 0 where no pair does."""
    out = np.empty(len(x))
    for k, v in enumerate(x):
        d = np.abs(v[:, None] - v[None, :]) < r * v.std()
        n = len(v) - 2
        two = d[:n, :n] & d[1 : n + 1, 1 : n + 1]
        three = two & d[2 : n + 2, 2 : n + 2]
        b, a = (two.sum() - n) // 2, (three.sum() - n) // 2
        out[k] = 0.0 if b <= 0 else np.nan if a <= 0 else -np.log(a / b)
    return out


def lempel_ziv(bits: np.ndarray) -> int:
    """Number of components of the exhaustive history of a binary string."""
    s = np.asarray(bits, np.uint8).tobytes()
    n, at, count = len(s), 0, 0
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        count += 1
        at += size
    return count


def lempel_ziv_normalised(x: np.ndarray) -> np.ndarray:
    """Of the signal above its mean, times log2 n / n."""
    n = x.shape[1]
    return np.array([lempel_ziv(v > v.mean()) for v in x]) * np.log2(max(n, 2)) / n


def epoch_dfa(x: np.ndarray, least: int = 4, factor: float = 1.2) -> np.ndarray:
    """Detrended fluctuation exponent of each epoch, scales from ``least`` to a tenth of its length; NaN with fewer than two."""
    n = x.shape[1]
    y = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    steps = range(int(np.log(n * 0.1 / least) / np.log(factor)) + 1) if n * 0.1 >= least else ()
    scales = sorted({int(least * factor**k) for k in steps})
    if len(scales) < 2:
        return np.full(len(x), np.nan)
    logs = []
    for s in scales:
        parts = y[:, : n // s * s].reshape(len(x), -1, s)
        t = np.arange(s) - (s - 1) / 2
        c = parts - parts.mean(axis=2, keepdims=True)
        left = (c**2).sum(axis=2) - (c @ t) ** 2 / (t @ t)
        logs.append(np.log(np.sqrt(np.maximum(left / s, 0).mean(axis=1)) + 1e-300))
    u = np.log(scales) - np.log(scales).mean()
    return np.array(logs).T @ u / (u @ u)


def dictionary_size(bits: np.ndarray) -> int:
    """Size of the dictionary that Lempel-Ziv-Welch builds over a bit string."""
    known, word = {b"\0", b"\1"}, b""
    for c in np.asarray(bits, np.uint8).tobytes():
        longer = word + bytes([c])
        if longer in known:
            word = longer
        else:
            known.add(longer)
            word = bytes([c])
    return len(known)


def multichannel_complexity(x: np.ndarray, seed: int = 0) -> float:
    """Channels x samples: amplitude above its mean, read sample by sample across channels, relative to a seeded
    shuffle."""
    n = x.shape[1]
    t = np.arange(n) - (n - 1) / 2
    x = x - x.mean(axis=1, keepdims=True)
    x = x - (x @ t / (t @ t))[:, None] * t
    amp = np.abs(analytic(x))
    bits = (amp > amp.mean(axis=1, keepdims=True)).T.ravel()
    shuffled = np.random.default_rng(seed).permutation(bits)
    return dictionary_size(bits) / dictionary_size(shuffled)


def canonical_features(x: np.ndarray) -> dict[str, np.ndarray]:
    """A part of the canonical time-series characteristics, on z-scored epochs."""
    z = (x - x.mean(axis=1, keepdims=True)) / np.maximum(x.std(axis=1, ddof=1, keepdims=True), 1e-12)
    n = z.shape[1]

    def mode(v, bins):
        c, e = np.histogram(v, bins)
        top = np.flatnonzero(c == c.max())
        return ((e[top] + e[top + 1]) / 2).mean()

    def longest(b):
        edges = np.flatnonzero(np.diff(np.r_[0, b.astype(int), 0]))
        return (edges[1::2] - edges[::2]).max(initial=0)

    f = np.fft.fft(z, 2 * n, axis=1)
    ac = np.fft.ifft(f * f.conj(), axis=1).real[:, :n]
    ac = ac / np.maximum(ac[:, :1], 1e-12)
    below = ac < np.exp(-1)
    dips = (np.diff(ac, axis=1)[:, 1:] > 0) & (np.diff(ac, axis=1)[:, :-1] < 0)
    d = np.diff(z, axis=1)
    return {
        "mode_5": np.array([mode(v, 5) for v in z]),
        "mode_10": np.array([mode(v, 10) for v in z]),
        "acf_timescale": np.where(below.any(axis=1), below.argmax(axis=1), n).astype(float),
        "acf_first_min": np.where(dips.any(axis=1), dips.argmax(axis=1) + 1, n).astype(float),
        "trev": (d**3).mean(axis=1),
        "high_fluctuation": (np.abs(d) * 1000 > 40).mean(axis=1),
        "stretch_high": np.array([longest(v > 0) for v in z]).astype(float),
        "stretch_decreasing": np.array([longest(v < 0) for v in d]).astype(float),
        "forecast_error": (z[:, 3:] - (z[:, :-3] + z[:, 1:-2] + z[:, 2:-1]) / 3).std(axis=1, ddof=1),
        "centroid_freq": (np.abs(np.fft.rfft(z, axis=1)) ** 2 @ np.arange(n // 2 + 1)) / np.maximum((np.abs(np.fft.rfft(z, axis=1)) ** 2).sum(axis=1), 1e-12) * 2 * np.pi / n,
        "low_freq_power": (np.abs(np.fft.rfft(z, axis=1)) ** 2)[:, : max(1, n // 10)].sum(axis=1) / np.maximum((np.abs(np.fft.rfft(z, axis=1)) ** 2).sum(axis=1), 1e-12),
    }


def sift(x: np.ndarray, rounds: int = 8, modes: int = 4) -> np.ndarray:
    """Intrinsic mode energies of one signal: sifting with piecewise-linear envelopes, the rest last."""
    out, rest, t = [], x.astype(float), np.arange(len(x))
    for _ in range(modes):
        h = rest.copy()
        for _ in range(rounds):
            d = np.diff(h)
            top = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            low = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(top) < 2 or len(low) < 2:
                break
            h = h - (np.interp(t, top, h[top]) + np.interp(t, low, h[low])) / 2
        out.append((h**2).mean())
        rest = rest - h
    return np.array([*out, (rest**2).mean()])


def morlet_power(x: np.ndarray, srate: float, freqs: list[float], cycles: float = 5.0) -> np.ndarray:
    """Mean power per epoch and frequency (epochs x frequencies) under Morlet wavelets of unit energy."""
    n = x.shape[1]
    out = np.empty((len(x), len(freqs)))
    for k, f in enumerate(freqs):
        sigma = cycles / (2 * np.pi * f)
        half = min(int(np.ceil(5 * sigma * srate)), n)
        t = np.arange(-half, half + 1) / srate
        w = np.exp(-(t**2) / (2 * sigma**2)) * np.exp(2j * np.pi * f * t)
        w /= np.sqrt((np.abs(w) ** 2).sum())
        size = 1 << int(np.ceil(np.log2(n + len(w))))
        y = np.fft.ifft(np.fft.fft(x, size, axis=1) * np.fft.fft(w, size), axis=1)[:, half : half + n]
        out[:, k] = (np.abs(y) ** 2).mean(axis=1)
    return out


def r_peaks(x: np.ndarray, srate: float) -> list[np.ndarray]:
    """Places of R peaks in each epoch: steep stretches of the band-passed signal, their largest value, at most one in
    0.3 s. Epochs that point down are turned first."""
    y = band_pass(x, srate, 5.0, min(30.0, srate / 2.2))
    down = np.abs(np.quantile(x, 0.15, axis=1)) > np.abs(np.quantile(x, 0.85, axis=1))
    y = np.where(down[:, None], -y, y)
    slope = np.abs(np.gradient(y, axis=1))
    width = max(1, int(0.1 * srate))
    box = np.ones(width) / width
    out = []
    for v, s in zip(y, slope, strict=True):
        smooth = np.convolve(s, box, "same")
        steep = smooth > 1.5 * smooth.mean()
        edges = np.flatnonzero(np.diff(np.r_[0, steep.astype(int), 0]))
        found: list[int] = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            p = a + int(v[a:b].argmax())
            if found and p - found[-1] < 0.3 * srate:
                if v[p] > v[found[-1]]:
                    found[-1] = p
            else:
                found.append(p)
        out.append(np.array(found, float))
    return out


def pair_substitutions(symbols: np.ndarray) -> int:
    """Effort to compress: rounds of replacing the most frequent pair by a new symbol until the sequence is constant."""
    s, rounds = list(symbols), 0
    while len(s) > 1 and len(set(s)) > 1:
        counts: dict = {}
        for a, b in zip(s, s[1:], strict=False):
            counts[a, b] = counts.get((a, b), 0) + 1
        pair = max(counts, key=lambda q: (counts[q], -q[0], -q[1]))
        new, out, i = max(s) + 1, [], 0
        while i < len(s):
            if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                out.append(new)
                i += 2
            else:
                out.append(s[i])
                i += 1
        s, rounds = out, rounds + 1
    return rounds


def compression_causality(x: np.ndarray, y: np.ndarray, bins: int = 2, past: int = 15, ahead: int = 8, step: int = 8) -> float:
    """Mean drop in the effort of y's next stretch once x's past stands in for part of y's."""
    cut = lambda v: np.minimum((v - v.min()) / max(np.ptp(v), 1e-12) * bins, bins - 1).astype(int)
    x, y = cut(x), cut(y)
    drops = []
    for t in range(past, len(y) - ahead + 1, step):
        own, next_ = y[t - past : t], y[t : t + ahead]
        joint = own * bins + x[t - past : t]
        rate = lambda a, b: (pair_substitutions(np.r_[a, b]) - pair_substitutions(a)) / ahead
        drops.append(rate(own, next_) - rate(joint, next_ * bins + x[t : t + ahead]))
    return float(np.mean(drops)) if drops else float("nan")
