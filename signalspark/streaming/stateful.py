"""Stream operators with typed state: cleaning of artifacts, ring buffers, filters, labelled trials.

They need ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``STATE_STORE``). Streams are of
frames: (key, ts, x) with the samples of all channels at a time as an array. State is bounded by windows and rates, never by
how long a stream runs; ``ttl`` clears the state of keys that no rows come for in so much processing time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from signalspark.operators.subspace import Cleaner

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPS = 1e-9


def _rows(parts: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(by, kind="stable")


def _flat(m: np.ndarray | None) -> list[float]:
    return [] if m is None else m.ravel().tolist()


# --- cleaning ------------------------------------------------------------------------------------------------
class _Clean(StatefulProcessor):
    """State: the model (matrices), the place (next sample, last samples, waiting samples with their times, last matrix)."""

    def __init__(self, key: str, window: int, step: int, ahead: int, max_share: float, silence_ms: int, ttl_ms: int | None):
        self.key, self.sizes, self.silence_ms, self.ttl_ms = key, (window, step, ahead, max_share), silence_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "chans array<string>, mixing array<double>, limits array<double>")
        self.place = handle.getValueState("place", "at long, ring array<double>, held array<double>, last array<double>, times array<long>, newest long", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.model.update((list(r["chans"]), [float(v) for v in r["mixing"]], [float(v) for v in r["limits"]]))

    def _load(self) -> tuple[Cleaner, list[int], int]:
        _, mixing, limits = self.model.get()
        n = int(round(np.sqrt(len(mixing))))
        c = Cleaner(np.array(mixing).reshape(n, n), np.array(limits).reshape(n, n), *self.sizes)
        if not self.place.exists():
            return c, [], 0
        at, ring, held, last, times, newest = self.place.get()
        c.at, c.ring, c.held = at, np.array(ring).reshape(n, -1), np.array(held, float).reshape(n, -1)
        c.last = np.array(last).reshape(n, n) if len(last) else None
        return c, list(times), newest

    def _told(self, key: tuple, told: list, times: list[int], first: int) -> Iterator[pd.DataFrame]:
        """Rows of cleaned samples that were there: ``times`` are stamps from sample ``first`` on, -1 for absent ones."""
        out = [(key[0], at + j, times[at + j - first], y[:, j].tolist()) for at, y in told for j in range(y.shape[1]) if 0 <= at + j - first < len(times) and times[at + j - first] >= 0]
        if out:
            frame = pd.DataFrame(out, columns=[self.key, "t", "us", "x"])
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _rows(rows, "t")
        if not self.model.exists():
            yield frame[[self.key, "t", "us", "x"]]
            return
        c, times, newest = self._load()
        n, first = len(c.mixing), c.at - len(times)
        told = []
        frame = frame[(frame["t"] >= c.at)].drop_duplicates("t")  # what comes after its turn is late
        for t, us, x in zip(frame["t"].tolist(), frame["us"].tolist(), frame["x"], strict=True):
            gap = t - c.at
            if gap:
                told += c.skip(gap)
                yield from self._told(key, told, times, first)
                told, waits = [], c.held.shape[1]
                # Stamps of what still waits; absent samples have none.
                kept = {first + k: s for k, s in enumerate(times)}
                first = c.at - waits
                times = [kept.get(first + k, -1) for k in range(waits)]
            told += c.push(np.array([0.0 if v is None or np.isnan(v) else v for v in x]).reshape(n, 1))
            times.append(us)
            newest = max(newest, us)
        yield from self._told(key, told, times, first)
        times = times[len(times) - c.held.shape[1] :]
        self.place.update((c.at, _flat(c.ring), _flat(c.held), _flat(c.last), times, newest))
        if self.silence_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(newest // 1000 + self.silence_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for so long: what waits is told."""
        if self.place.exists():
            c, times, newest = self._load()
            first = c.at - len(times)
            yield from self._told(key, c.flush(), times, first)
            self.place.update((c.at, _flat(c.ring), [], _flat(c.last), [], newest))


def clean_stream(
    frames: DataFrame, model: DataFrame, key: str, window: int, step: int, ahead: int, late: str, max_share: float = 0.66, silence_ms: int = 0, ttl_ms: int | None = None, ts: str = "ts"
) -> DataFrame:
    """(key, t, ts, x): frames (key, t, ts, x) with artifact directions rebuilt, by a model per key fitted before
    (``subspace.subspace_model``, its key column of the same name); ``x`` is in the order of the model's channels.

    However the stream is cut into batches, the samples told are those of ``subspace.subspace_clean`` over the recording; they come
    when ``ahead`` samples and the rest of a step are in. What still waits is told after ``silence_ms`` of event time without
    rows (0: never). Rows of a key come in order of ``t`` from batch to batch: numbers passed over are gaps (0 to the covariance),
    and a row whose turn has passed is late and left out, as is a repeated one. Null values count as 0. Keys without a model pass
    as they are."""
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (key, "t")}
    rows = frames.withWatermark(ts, late).select(key, F.col("t").cast("long").alias("t"), F.unix_micros(ts).alias("us"), "x", ts)
    fitted = model.select(key, "chans", "mixing", "limits").groupBy(key)
    work = _Clean(key, window, step, ahead, max_share, silence_ms, ttl_ms)
    out = rows.groupBy(key).transformWithStateInPandas(work, f"{key} {kinds[key]}, t long, us long, x array<double>", "Append", "EventTime", initialState=fitted)
    return out.select(key, "t", F.timestamp_micros("us").alias(ts), "x")


# --- ring buffer ---------------------------------------------------------------------------------------------
class _Ring(StatefulProcessor):
    """State: samples of the last ``width`` (a list), the next tick and the newest sample."""

    def __init__(self, key: str, srate: float, width_us: int, every_us: int, patience_us: int, default: float, ttl_ms: int | None):
        self.key, self.srate, self.width, self.every, self.patience, self.default, self.ttl_ms = key, srate, width_us, every_us, patience_us, default, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "us long, x double", self.ttl_ms)
        self.clock = handle.getValueState("clock", "tick long, newest long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _rows(rows, "us")
        us = frame["us"].tolist()
        if self.clock.exists():
            tick, newest = self.clock.get()
        else:
            tick, newest = (us[0] // self.every + 1) * self.every, us[0]
        self.samples.appendList([(u, None if pd.isna(x) else float(x)) for u, x in zip(us, frame["x"].tolist(), strict=True) if u >= tick - self.width])
        if tick - self.every > newest + self.patience and us[-1] > newest:  # silent so far: ticks go on with the new rows
            tick = max(tick, (us[0] // self.every + 1) * self.every)
        self.clock.update((tick, max(newest, us[-1])))
        self.handle.registerTimer(tick // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        tick, newest = self.clock.get()
        held = {u: x for u, x in self.samples.get()} if self.samples.exists() else {}
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        n = int(round(self.width * self.srate / 1e6))
        out = []
        while tick <= mark and tick - self.every <= newest + self.patience:
            x = [self.default] * n
            for u in sorted(held):
                i = int(np.ceil((u - (tick - self.width)) * self.srate / 1e6 - EPS))
                if 0 <= i < n and held[u] is not None and u < tick:
                    x[i] = held[u]
            out.append((key[0], tick, x))
            tick += self.every
        kept = [(u, x) for u, x in sorted(held.items()) if u >= tick - self.width]
        self.samples.put(kept) if kept else self.samples.clear()
        self.clock.update((tick, newest))
        if tick - self.every <= newest + self.patience:
            self.handle.registerTimer(tick // 1000)
        if out:
            yield pd.DataFrame(out, columns=[self.key, "us", "x"])


def _micros(text: str) -> int:
    return int(pd.Timedelta(text) / pd.Timedelta(microseconds=1))


def ring_buffer(samples: DataFrame, key: str, srate: float, width: str, every: str, late: str, patience: str = "0 seconds", default: float = 0.0, ttl_ms: int | None = None, ts: str = "ts", value: str = "x") -> DataFrame:
    """(key, ts, x): at each multiple of ``every`` the samples of the last ``width`` on a grid of ``srate``, once the
    watermark (``late`` behind the newest row) has passed it.

    Grid places without a sample, before the first one, in gaps or after the last one, read ``default``, as do nulls; a
    sample holds from the grid place at or after its time, of several the last. Ticks come from timers, so a silent key goes on
    telling windows up to the first tick beyond ``patience`` after its newest sample, as long as other keys move the watermark. Rows later than ``late``
    are left out. The state of a key is the samples of ``width`` and ``late``."""
    kind = samples.schema[key].dataType.simpleString()
    rows = samples.withWatermark(ts, late).select(key, F.unix_micros(ts).alias("us"), F.col(value).cast("double").alias("x"), ts)
    work = _Ring(key, srate, _micros(width), _micros(every), _micros(patience), default, ttl_ms)
    out = rows.groupBy(key).transformWithStateInPandas(work, f"{key} {kind}, us long, x array<double>", "Append", "EventTime")
    return out.select(key, F.timestamp_micros("us").alias(ts), "x")


# --- features in the stream ------------------------------------------------------------------------------------
class _Filter(StatefulProcessor):
    """State: the filter's memory (direct form II transposed), one number per coefficient."""

    def __init__(self, key: str, ts: str, b: list[float], a: list[float], ttl_ms: int | None):
        n = max(len(a), len(b))
        self.key, self.ts, self.ttl_ms = key, ts, ttl_ms
        self.b, self.a = np.array(b + [0.0] * (n - len(b))), np.array(a + [0.0] * (n - len(a)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "z array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _rows(rows, self.ts)
        z = np.array(self.memory.get()[0]) if self.memory.exists() else np.zeros(len(self.b))
        out = np.empty(len(frame))
        for k, x in enumerate(frame["x"].to_numpy(float)):
            out[k] = self.b[0] * x + z[0]
            z[:-1] = self.b[1:] * x + z[1:] - self.a[1:] * out[k]
        self.memory.update((z.tolist(),))
        yield pd.DataFrame({self.key: key[0], self.ts: frame[self.ts].to_numpy(), "x": out})


def filtered_mean(frames: DataFrame, key: str, coefficients: tuple[list[float], list[float]], late: str, ttl_ms: int | None = None, ts: str = "ts") -> DataFrame:
    """(key, ts, x): the mean of the channels of each frame, filtered with memory from batch to batch.

    ``coefficients``: (b, a) with a[0] = 1. The filter is linear, so it is applied once to the mean. Frames without values and
    null values are left out of the mean; a frame with none is left out. The event time goes on to operators behind."""
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (key, ts)}
    there = F.filter("x", lambda v: v.isNotNull())
    rows = frames.withWatermark(ts, late).select(key, ts, (F.aggregate(there, F.lit(0.0), lambda s, v: s + v) / F.size(there)).alias("x")).where("x is not null")
    b, a = ([float(v) for v in c] for c in coefficients)
    return rows.groupBy(key).transformWithStateInPandas(_Filter(key, ts, b, a, ttl_ms), f"{key} {kinds[key]}, {ts} {kinds[ts]}, x double", "Append", "EventTime", eventTimeColumnName=ts)


def feature_stream(frames: DataFrame, key: str, coefficients: tuple[list[float], list[float]], width: str, slide: str, late: str, srate: float, spec=None, ts: str = "ts") -> DataFrame:
    """Features of sliding windows of the filtered channel mean: (key, start, one column per feature), append mode.

    A chain of stateful operators: filter, then windows; the features are expressions on the window's array. Windows that lack
    samples (at the start or in gaps) are left out."""
    from signalspark.plans.features import generate_features

    n = int(round(pd.Timedelta(width).total_seconds() * srate))
    y = filtered_mean(frames, key, coefficients, late, ts=ts)
    pairs = y.groupBy(key, F.window(ts, width, slide).alias("w")).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col("x").alias("v")))).alias("s"))
    epochs = pairs.select(key, F.col("w.start").alias("start"), F.col("s.v").alias("x")).where(F.size("x") == n)
    return generate_features(epochs, [key, "start"], srate, n, spec)


# --- labelled trials -------------------------------------------------------------------------------------------
class _Trials(StatefulProcessor):
    """State: frames not older than what a trial may need, and open trials."""

    def __init__(self, key: str, length_us: int, epoch_us: int, samples: int, ttl_ms: int | None):
        self.key, self.length, self.epoch, self.samples, self.ttl_ms = key, length_us, epoch_us, samples, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "us long, x array<double>", self.ttl_ms)
        self.open = handle.getMapState("open", "onset long, condition string", "there boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _rows(rows, "us")
        for us, condition in frame.loc[frame["is_marker"], ["us", "condition"]].itertuples(index=False):
            self.open.updateValue((us, condition), (True,))
            self.handle.registerTimer((us + self.length) // 1000)
        new = frame[~frame["is_marker"]]
        if len(new):
            self.frames.appendList(list(zip(new["us"].tolist(), [[float("nan") if v is None else float(v) for v in x] for x in new["x"]], strict=True)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        trials = sorted((k for k in self.open.keys()), key=str) if self.open.exists() else []
        frames = sorted(self.frames.get()) if self.frames.exists() else []
        out, left = [], []
        for onset, condition in trials:
            if onset + self.length > mark:
                left.append(onset)
                continue
            for e in range(self.length // self.epoch):
                a = onset + e * self.epoch
                xs = [x for us, x in frames if a <= us < a + self.epoch]
                if len(xs) == self.samples:
                    out += [(key[0], onset, condition, e, c, [float(v) for v in channel]) for c, channel in enumerate(zip(*xs, strict=True))]
            self.open.removeKey((onset, condition))
        # Markers still to come are not older than the watermark.
        least = min([mark, *left])
        kept = [(us, x) for us, x in frames if us >= least]
        self.frames.put(kept) if kept else self.frames.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "us", "condition", "epoch", "chan", "x"])


def trial_epochs(frames: DataFrame, markers: DataFrame, key: str, srate: float, length: str, epoch: str, late: str, ttl_ms: int | None = None, ts: str = "ts") -> DataFrame:
    """(key, onset, condition, epoch, chan, x): windows of ``epoch`` from each marker (key, ts, condition) on, for ``length``,
    labelled with its condition, told when the watermark has passed the trial's end.

    Both streams meet in one operator as one; trials may overlap, and those of one time and several conditions are told once
    each. Windows that lack samples are left out; null samples are NaN. Rows and markers later than ``late`` are left out. For
    replays use the trigger ``availableNow``; trials that the last watermark does not pass wait for more rows."""
    kind = frames.schema[key].dataType.simpleString()
    null = F.lit(None)
    a = frames.select(key, ts, F.col("x").cast("array<double>").alias("x"), null.cast("string").alias("condition"), F.lit(False).alias("is_marker"))
    b = markers.select(key, ts, null.cast("array<double>").alias("x"), F.col("condition").cast("string").alias("condition"), F.lit(True).alias("is_marker"))
    rows = a.unionByName(b).withWatermark(ts, late).withColumn("us", F.unix_micros(ts))
    per = int(round(pd.Timedelta(epoch).total_seconds() * srate))
    work = _Trials(key, _micros(length), _micros(epoch), per, ttl_ms)
    out = rows.groupBy(key).transformWithStateInPandas(work, f"{key} {kind}, us long, condition string, epoch long, chan int, x array<double>", "Append", "EventTime")
    return out.select(key, F.timestamp_micros("us").alias("onset"), "condition", "epoch", "chan", "x")


def labelled_features(frames: DataFrame, markers: DataFrame, key: str, srate: float, length: str, epoch: str, late: str, spec=None, ts: str = "ts") -> DataFrame:
    """Features of ``trial_epochs`` with the condition as label: (key, onset, condition, epoch, chan, one column per feature)."""
    from signalspark.plans.features import generate_features

    rows = trial_epochs(frames, markers, key, srate, length, epoch, late, ts=ts)
    return generate_features(rows, [key, "onset", "condition", "epoch", "chan"], srate, int(round(pd.Timedelta(epoch).total_seconds() * srate)), spec)
