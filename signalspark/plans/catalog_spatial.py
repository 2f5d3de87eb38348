"""Queries that use positions of channels, and filters by design, with the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from signalspark.functions.arrays import rnd
from signalspark.operators import filters, spatial
from signalspark.plans.catalog_graph import BLOCKS, _channels
from signalspark.plans.inputs import SIG, SRATE, with_
from signalspark.plans.registry import query


def _montage(n: int = 8) -> dict[int, tuple[float, float, float]]:
    """Channels on a spiral over the upper part of a sphere."""
    out = {}
    for k in range(n):
        z, a = 0.95 - 1.2 * k / (n - 1), k * np.pi * (3 - np.sqrt(5))
        out[k] = (float(np.sqrt(1 - z * z) * np.cos(a)), float(np.sqrt(1 - z * z) * np.sin(a)), float(z))
    return out


MONTAGE = _montage()
SHARE, COUNT, WINDOW, SEGMENT = 0.5, 20, 64, 256


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) if isinstance(v, int) else f"{v!r}::DOUBLE" for v in r) + ")" for r in rows) + ")"


# A smooth field of three sources over the montage, with a little of each channel; channel 5 is its own.
FIELD = f"""ps AS (SELECT * FROM {_values((c, *p) for c, p in MONTAGE.items())} v(chan, px, py, pz)),
so AS (SELECT label, t, MAX(x) FILTER (WHERE chan = 0) AS s0, MAX(x) FILTER (WHERE chan = 1) AS s1, MAX(x) FILTER (WHERE chan = 2) AS s2, COUNT(*) AS present FROM ch GROUP BY ALL HAVING COUNT(*) FILTER (WHERE chan < 3) = 3),
fl AS (SELECT ch.label, ch.chan, ch.t, present, CASE WHEN ch.chan = 5 THEN x ELSE pz * s0 + px * s1 + py * s2 + 0.1 * x END AS x FROM ch JOIN so ON ch.label = so.label AND ch.t = so.t JOIN ps ON ch.chan = ps.chan)"""


def _field(spark, d):
    """(label, chan, t, present, x)."""
    ch = _channels(spark, d)
    source = lambda k: F.max(F.when(F.col("chan") == k, F.col("x"))).alias(f"s{k}")
    so = ch.groupBy("label", "t").agg(source(0), source(1), source(2), F.count("*").alias("present"))
    so = so.where("s0 is not null and s1 is not null and s2 is not null")
    ps = F.broadcast(spark.createDataFrame([(c, *p) for c, p in MONTAGE.items()], "chan int, px double, py double, pz double"))
    x = F.when(F.col("chan") == 5, F.col("x")).otherwise(F.expr("pz * s0 + px * s1 + py * s2 + 0.1D * x"))
    return ch.join(so, ["label", "t"]).join(ps, "chan").select("label", F.col("chan").cast("int").alias("chan"), "t", "present", x.alias("x"))


@query(
    with_(SIG, BLOCKS, FIELD)
    + f""", wt AS (SELECT * FROM {_values(spatial.subset_weights(MONTAGE, SHARE, COUNT))} v(k, target, chan, w)),
ft AS (SELECT *, t // {WINDOW} AS win FROM fl),
nt AS (SELECT label, win, COUNT(DISTINCT t) AS n FROM ft GROUP BY ALL),
fu AS (SELECT ft.label, ft.win, chan FROM ft JOIN nt ON ft.label = nt.label AND ft.win = nt.win GROUP BY ft.label, ft.win, chan, n HAVING COUNT(*) = n),
ok AS (SELECT label, win, k FROM (SELECT DISTINCT k, chan FROM wt) m JOIN fu ON m.chan = fu.chan GROUP BY label, win, k HAVING COUNT(*) = {int(SHARE * len(MONTAGE))}),
pp AS (SELECT ft.label, ft.win, wt.k, wt.target, ft.t, SUM(w * x) AS p FROM ok JOIN wt ON ok.k = wt.k JOIN ft ON ft.label = ok.label AND ft.win = ok.win AND ft.chan = wt.chan GROUP BY ALL),
md AS (SELECT label, win, target AS chan, t, MEDIAN(p) AS p FROM pp GROUP BY ALL),
rr AS (SELECT fu.label, fu.win, fu.chan, CORR(md.p, ft.x) AS r FROM fu JOIN ft ON fu.label = ft.label AND fu.win = ft.win AND fu.chan = ft.chan LEFT JOIN md ON md.label = ft.label AND md.chan = ft.chan AND md.t = ft.t GROUP BY ALL)
SELECT label, chan, COUNT(*) AS windows, COUNT(*) FILTER (WHERE r IS NULL OR r < 0.75) AS low, ROUND(AVG(r), 6) + 0.0 AS mean_r, COUNT(*) FILTER (WHERE r IS NULL OR r < 0.75) > 0.4 * COUNT(*) AS bad FROM rr GROUP BY label, chan"""
)
def unpredicted_channels(spark, d):
    """Channels that subsets of the others do not predict, by spherical splines and votes of windows."""
    out = spatial.unpredicted_channels(_field(spark, d), ["label"], MONTAGE, WINDOW, share=SHARE, count=COUNT)
    return out.select("label", "chan", "windows", "low", rnd(F.col("mean_r")).alias("mean_r"), "bad")


def _fill_rows():
    """(case, target, chan, w): case 0 lacks channels 5 and 6, case 1 lacks 5."""
    where = np.array([MONTAGE[c] for c in sorted(MONTAGE)])
    for case, lack in ((0, [5, 6]), (1, [5])):
        have = [c for c in MONTAGE if c not in lack]
        w = spatial.spline_weights(where[have], where[lack])
        yield from ((case, i, j, float(w[a, b])) for a, i in enumerate(lack) for b, j in enumerate(have))


@query(
    with_(SIG, BLOCKS, FIELD)
    + f""", wt AS (SELECT * FROM {_values(_fill_rows())} v(odd, target, chan, w)),
al AS (SELECT label, chan, t, x FROM fl WHERE present = 8 AND chan <> 5 AND NOT (chan = 6 AND t // {SEGMENT} % 2 = 0))
SELECT label, chan, t, FALSE AS filled, ROUND(x, 6) + 0.0 AS x FROM al UNION ALL
SELECT label, target, t, TRUE, ROUND(SUM(w * x), 6) + 0.0 FROM al JOIN wt ON al.chan = wt.chan AND t // {SEGMENT} % 2 = odd GROUP BY label, target, t"""
)
def filled_channels(spark, d):
    """Channels that a segment lacks, by spherical splines through the others."""
    even = F.floor(F.col("t") / SEGMENT) % 2 == 0
    lost = (F.col("chan") == 5) | ((F.col("chan") == 6) & even)
    have = _field(spark, d).where((F.col("present") == 8) & ~lost)
    out = spatial.fill_channels(have, ["label"], MONTAGE, SEGMENT)
    return out.select("label", "chan", "t", lost.alias("filled"), rnd(F.col("x")).alias("x"))


@query(
    with_(SIG, BLOCKS)
    + """, wn AS (SELECT n, 0.54 + 0.46 * COS(PI() * n / 53) AS h FROM range(-53, 54) v(n)),
sc AS (SELECT n, h * CASE WHEN n = 0 THEN 2 * 13.5 / 64 ELSE SIN(2 * PI() * 13.5 / 64 * n) / (PI() * n) END AS hi, h * CASE WHEN n = 0 THEN 2 * 3.0 / 64 ELSE SIN(2 * PI() * 3.0 / 64 * n) / (PI() * n) END AS lo FROM wn),
tp AS (SELECT n, hi / SUM(hi) OVER () - lo / SUM(lo) OVER () AS w FROM sc),
co AS (SELECT label, chan, t + n AS t, SUM(w * x) AS y FROM ch, tp GROUP BY ALL)
SELECT ch.label, ch.chan, ch.t, ROUND(y, 6) + 0.0 AS x FROM ch JOIN co ON ch.label = co.label AND ch.chan = co.chan AND ch.t = co.t"""
)
def band_filter(spark, d):
    """Channels between 4 and 12 Hz by a windowed sinc filter without delay, in segments with halos."""
    out = filters.fir_centred(_channels(spark, d), ["label", "chan"], filters.band_taps(SRATE, 4.0, 12.0), segment=1024)
    return out.select("label", "chan", "t", rnd(F.col("x")).alias("x"))
