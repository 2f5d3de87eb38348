"""Artifact subspace reconstruction with a moving covariance.

The model of a recording is learned from all of its blocks: block covariances are rows, their geometric median is found by rounds
of one weighted mean each (Weiszfeld), limits from quantiles, so nothing of a recording comes together in one task but a matrix.

Cleaning looks at the covariance of the last ``window`` samples every ``step`` samples. What it does at a sample depends
on ``window`` samples before, so a recording is cut into segments that carry as many of the samples before them (a halo), and
any number of tasks give the result of one pass. ``Cleaner`` is that pass; streams use it too (``streaming.stateful``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.operators.lineage import cut


# --- learning ------------------------------------------------------------------------------------------------
def geometric_medians(points: DataFrame, keys: list[str], vector: str, tol: float = 1e-5, rounds: int = 100) -> DataFrame:
    """(keys, <vector>): per key the point of least summed distance to the rows' arrays.

    A round is one weighted mean with partial sums; rounds stop when no key moves by more than ``tol`` of its length.
    Where the mean falls on rows, the step is shortened by their pull (Vardi and Zhang)."""
    rows = points.select(*keys, F.col(vector).alias("p"))
    here = cut(rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("p"))).alias("y")))
    for _ in range(rounds):
        far = rows.join(here, keys).withColumn("d", _length(_minus("p", "y"))).withColumn("w", F.when(F.col("d") > 1e-12, 1 / F.col("d")).otherwise(0.0))
        mean = vector_to_array(Summarizer.mean(array_to_vector("p"), F.col("w")))
        # A key whose rows all lie on the point has weight 0 everywhere and stays where it is.
        sums = far.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum((F.col("w") == 0).cast("double")).alias("at"), F.first("y").alias("y"))
        moves = far.where("w > 0").groupBy(*keys).agg(mean.alias("m")).join(sums, keys, "right")
        pull = F.col("w") * _length(_minus("m", "y"))
        part = F.when((F.col("at") == 0) | F.col("m").isNull(), 0.0).when(pull > 0, F.least(F.lit(1.0), F.col("at") / pull)).otherwise(1.0)
        new = F.when(F.col("m").isNull(), F.col("y")).otherwise(F.zip_with("m", "y", lambda m, y: (1 - part) * m + part * y))
        moved = _length(F.zip_with(new, "y", lambda a, b: a - b)) > tol * F.greatest(F.lit(1e-12), _length(F.col("y")))
        here = cut(moves.select(*keys, new.alias("y"), moved.alias("moved")))
        if here.where("moved").isEmpty():
            break
    return here.select(*keys, F.col("y").alias(vector))


def _minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def subspace_model(df: DataFrame, keys: list[str], block: int, cutoff: float, chan: str = "chan", t: str = "t", value: str = "x") -> DataFrame:
    """(keys, chans, mixing, limits): per recording the mixing matrix M, the square root of the geometric median of its block
    covariances, and the limits T, amplitudes of its components above which a direction counts as an artifact.

    All blocks of ``block`` samples count, whatever their number. A channel is flat (0) where a block lacks it. Limits are
    median and quartile distance of the components' amplitudes per block, by quantiles exact to a ten-thousandth in rank."""
    name = F.col(chan).cast("string")
    chans = cut(df.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("chans")))
    rows = df.select(*keys, F.floor(F.col(t) / block).alias("block"), name.alias(chan), t, value).join(chans, keys)
    heads = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def covariance(key, part: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(part, list(part["chans"].iloc[0]), None, chan, t, value)[0]
        return pd.DataFrame([(*key[:-1], (x @ x.T / max(1, x.shape[1])).ravel().tolist())], columns=[*keys, "cov"])

    covs = cut(rows.groupBy(*keys, "block").applyInPandas(lambda key, part: covariance(key, part), f"{heads}, cov array<double>"))

    def roots(parts):
        for p in parts:
            out = []
            for c in p["cov"]:
                n = int(round(np.sqrt(len(c))))
                m = np.array(c).reshape(n, n)
                w, v = np.linalg.eigh((m + m.T) / 2)
                out.append((((v * np.sqrt(np.maximum(w, 0))) @ v.T).ravel().tolist(), v.ravel().tolist()))
            mixing, axes = zip(*out, strict=True) if out else ((), ())
            yield p.drop(columns="cov").assign(mixing=list(mixing), axes=list(axes))

    centre = cut(geometric_medians(covs, keys, "cov").mapInPandas(roots, f"{heads}, mixing array<double>, axes array<double>"))

    def amplitudes(parts):
        for p in parts:
            out = []
            for c, a in zip(p["cov"], p["axes"], strict=True):
                n = int(round(np.sqrt(len(c))))
                v = np.array(a).reshape(n, n)
                out.append(np.sqrt(np.maximum(((np.array(c).reshape(n, n) @ v) * v).sum(axis=0), 0)).tolist())
            yield p[keys].assign(rms=out)

    rms = covs.join(centre.select(*keys, "axes"), keys).mapInPandas(amplitudes, f"{heads}, rms array<double>")
    rms = rms.select(*keys, F.posexplode("rms").alias("component", "a"))
    q = rms.groupBy(*keys, "component").agg(F.percentile_approx("a", F.lit([0.25, 0.5, 0.75]), F.lit(10_000)).alias("q"))
    limit = F.col("q")[1] + cutoff * F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.35, F.lit(1e-12))
    limits = q.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("component", limit.alias("l")))).getField("l").alias("l"))
    n = F.size("l")
    # T = diag(limits) V': row i is component i, column j channel j.
    rows_of = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.col("l")[i] * F.col("axes")[j * n + i]))
    return centre.join(limits, keys).join(chans, keys).select(*keys, "chans", "mixing", F.flatten(rows_of).alias("limits"))


# --- one pass ------------------------------------------------------------------------------------------------
def rebuilding(cov: np.ndarray, mixing: np.ndarray, limits: np.ndarray, max_share: float) -> np.ndarray | None:
    """The matrix that rebuilds directions beyond their limits from the others; None where none is."""
    n = len(cov)
    d, v = np.linalg.eigh(cov)
    keep = (d < ((limits @ v) ** 2).sum(axis=0)) | (np.arange(n) < n - round(max_share * n))
    return None if keep.all() else mixing @ np.linalg.pinv(keep[:, None] * (v.T @ mixing)) @ v.T


@dataclass
class Cleaner:
    """A pass over samples in order. ``at`` is the number of the next sample, ``ring`` the last ``window`` samples (0 before
    the first), ``held`` the samples that wait for ``ahead`` more, ``last`` the matrix of the step before.

    Steps end at multiples of ``step``, so how the samples are cut into calls does not matter."""

    mixing: np.ndarray
    limits: np.ndarray
    window: int
    step: int
    ahead: int
    max_share: float = 0.66
    at: int = 0
    ring: np.ndarray | None = None
    held: np.ndarray | None = None
    last: np.ndarray | None = None
    out: list = field(default_factory=list)

    def __post_init__(self):
        n = len(self.mixing)
        self.ring = np.zeros((n, self.window)) if self.ring is None else self.ring
        self.held = np.zeros((n, 0)) if self.held is None else self.held

    def push(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(number of the first, cleaned samples) that are decided with ``x``, which comes next."""
        out = []
        while x.shape[1]:
            k = min(x.shape[1], self.step - self.at % self.step)
            part, x = x[:, :k], x[:, k:]
            self.ring = np.concatenate([self.ring, part], axis=1)[:, -self.window :]
            self.held = np.concatenate([self.held, part], axis=1)
            self.at += k
            if self.at % self.step == 0:
                out += self._step()
        return out

    def _step(self) -> list[tuple[int, np.ndarray]]:
        now = rebuilding(self.ring @ self.ring.T / self.window, self.mixing, self.limits, self.max_share)
        k = max(0, self.held.shape[1] - self.ahead)
        first, x = self.at - self.held.shape[1], self.held[:, :k]
        if k and not (now is None and self.last is None):
            blend = (1 - np.cos(np.pi * np.arange(1, k + 1) / k)) / 2
            x = blend * (x if now is None else now @ x) + (1 - blend) * (x if self.last is None else self.last @ x)
        self.held, self.last = self.held[:, k:], now
        return [(first, x)] if k else []

    def skip(self, n: int) -> list[tuple[int, np.ndarray]]:
        """As ``push`` of ``n`` samples of 0. Beyond what can matter to later samples the pass jumps."""
        settle = -(-(self.window + self.ahead + 2 * self.step) // self.step) * self.step
        zeros = np.zeros((len(self.mixing), min(n, settle + self.step)))
        out = self.push(zeros)
        jump = (n - zeros.shape[1]) // self.step * self.step
        self.at += max(0, jump)  # ring, held samples and matrix are those of zeros
        rest = n - zeros.shape[1] - max(0, jump)
        return out + self.push(np.zeros((len(self.mixing), rest)))

    def flush(self) -> list[tuple[int, np.ndarray]]:
        """The samples that wait, as nothing comes after them."""
        if not self.held.shape[1]:
            return []
        x = self.held if self.last is None else self.last @ self.held
        first, self.held = self.at - self.held.shape[1], self.held[:, :0]
        return [(first, x)]


# --- recordings in segments ------------------------------------------------------------------------------------
def _matrix(part: pd.DataFrame, chans: list[str], times: np.ndarray | None, chan: str, t: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """(channels x times, whether a sample is there); absent ones are 0, repeated ones averaged."""
    stamps = np.sort(part[t].unique()) if times is None else times
    row = part[chan].astype(str).map({c: i for i, c in enumerate(chans)})
    use = row.notna().to_numpy() & part[value].notna().to_numpy()
    row, col = row[use].to_numpy(int), np.searchsorted(stamps, part[t].to_numpy()[use])
    x, n = np.zeros((2, len(chans), len(stamps)))
    np.add.at(x, (row, col), part[value].to_numpy(float)[use])
    np.add.at(n, (row, col), 1)
    return x / np.maximum(n, 1), n > 0


def subspace_clean(
    df: DataFrame, model: DataFrame, keys: list[str], window: int, step: int, ahead: int, segment: int = 1 << 16, max_share: float = 0.66, chan: str = "chan", t: str = "t", value: str = "x"
) -> DataFrame:
    """(keys, chan, t, x): recordings with artifact directions rebuilt; t counts samples from 0.

    Every ``step`` samples the covariance of the last ``window`` decides; a decision is blended in over a step that lies
    ``ahead`` samples back. Equal to one pass over the whole recording, whatever ``segment`` is: a segment (a multiple of
    ``step``) brings ``window`` samples of the one before. A channel or sample that is absent counts as 0, and no rows are
    made for it; null values are absent. Rows of channels that the model does not know, and recordings without a model,
    come out as they are. Repeated samples are averaged. No rows: no result."""
    halo = -(-max(window, ahead) // step) * step
    segment = max(-(-segment // step) * step, halo)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (*keys, chan, t)}
    rows = df.select(*keys, chan, t, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    known = model.select(*keys, F.explode("chans").alias("its chan"))
    on = [rows[k] == known[k] for k in keys] + [rows[chan].cast("string") == known["its chan"]]
    others = rows.join(known, on, "left_anti")
    mine = rows.join(known, on, "left_semi")
    last = mine.groupBy(*keys).agg(F.floor(F.max(t) / segment).alias("last segment"))
    seg = F.floor(F.col(t) / segment)
    both = F.when(F.col(t) >= (seg + 1) * segment - halo, F.array(seg, seg + 1)).otherwise(F.array(seg))
    # Where nothing lies in a segment, its neighbour's halo alone makes no rows.
    mine = mine.withColumn("segment", F.explode(both))
    # The model comes to a segment once, not with each sample.
    group = [*keys, "segment"]
    models = mine.select(*group).distinct().join(model.join(last, keys), keys)
    models = models.select(*(F.col(k).alias(f"its {k}") for k in group), "chans", "mixing", "limits", "last segment")

    def run(key, part: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({chan: pd.Series([], dtype=object), t: pd.Series([], dtype="int64"), value: pd.Series([], dtype=float)})
        if part.empty or its.empty or key[-1] > its["last segment"].iloc[0]:
            return none.assign(**{k: part[k].head(0).astype(object if isinstance(v, str) else part[k].dtype) for k, v in zip(keys, key[:-1], strict=True)})[[*keys, chan, t, value]]
        chans, start = list(its["chans"].iloc[0]), int(key[-1]) * segment
        n, first = len(chans), max(0, start - halo)
        final = key[-1] == its["last segment"].iloc[0]
        stop = int(part[t].max()) + 1 if final else start + segment
        x, there = _matrix(part, chans, np.arange(first, stop), chan, t, value)
        c = Cleaner(np.array(its["mixing"].iloc[0]).reshape(n, n), np.array(its["limits"].iloc[0]).reshape(n, n), window, step, ahead, max_share, at=first)
        c.push(x[:, : start - first])
        told = c.push(x[:, start - first :]) + (c.flush() if final else [])
        out = []
        for at, y in told:
            # Chan and time as they came in: the names of rows of this stretch.
            i, j = np.nonzero(there[:, at - first : at - first + y.shape[1]])
            out.append(pd.DataFrame({chan: np.array(chans, object)[i], t: at + j, value: y[i, j]}))
        frame = pd.concat(out, ignore_index=True) if out else none
        # As objects: pieces of strings put together would not reach Arrow as one array.
        frame = frame.astype({chan: object}).assign(**{k: pd.Series([v] * len(frame), index=frame.index, dtype=object if isinstance(v, str) else None) for k, v in zip(keys, key[:-1], strict=True)})
        return frame[[*keys, chan, t, value]]

    heads = ", ".join(f"{k} {kinds[k]}" for k in keys)
    done = mine.groupBy(*group).cogroup(models.groupBy(*(f"its {k}" for k in group))).applyInPandas(lambda key, part, its: run(key, part, its), f"{heads}, {chan} string, {t} long, {value} double")
    done = done.select(*keys, F.col(chan).cast(kinds[chan]).alias(chan), F.col(t).cast(kinds[t]).alias(t), value)
    return done.unionByName(others)
