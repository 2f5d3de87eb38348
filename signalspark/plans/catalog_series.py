"""Queries on long series: windows, fluctuation analysis, events, time joins, beats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalspark.functions.arrays import rnd
from signalspark.operators import cardiac, cleaning, events, joins, segment, series
from signalspark.plans.inputs import DAY, EVT, SUP, daily_series, event_series, supplier_series, with_
from signalspark.plans.registry import query

OUT = "chan, i, ROUND(y, 6) + 0.0 AS y"


def _out(df, y="y"):
    return df.select("chan", F.col("i").cast("long").alias("i"), rnd(F.col(y)).alias("y"))


@query(with_(SUP) + f"SELECT {OUT} FROM (SELECT chan, i, (x - AVG(x) OVER w) / STDDEV_POP(x) OVER w AS y FROM sup WINDOW w AS (PARTITION BY chan))")
def zscore(spark, d):
    return _out(series.zscore(supplier_series(spark, d), ["chan"], out="y"))


@query(with_(SUP, "f AS (SELECT chan, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM sup GROUP BY 1)") + "SELECT chan, i, ROUND(x - (a + b * i), 4) + 0.0 AS y FROM sup JOIN f USING (chan)")
def detrend(spark, d):
    return series.detrend(supplier_series(spark, d), ["chan"]).select("chan", F.col("i").cast("long").alias("i"), rnd(F.col("y"), 4).alias("y"))


@query(with_(SUP) + f"SELECT {OUT} FROM (SELECT chan, i, SUM(x) OVER (PARTITION BY chan ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 AS y FROM sup)")
def box_smooth(spark, d):
    return _out(series.box_smooth(supplier_series(spark, d), ["chan"], 6))


@query(with_(SUP) + f"SELECT {OUT} FROM (SELECT chan, i, SUM(x) OVER (PARTITION BY chan ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) / 8 AS y FROM sup)")
def moving_average_filter(spark, d):
    return _out(series.trailing_mean(supplier_series(spark, d), ["chan"], 8))


@query(with_(SUP) + f"SELECT {OUT} FROM (SELECT chan, i, 0.5 * x + 0.3 * COALESCE(LAG(x) OVER w, 0) + 0.2 * COALESCE(LAG(x, 2) OVER w, 0) AS y FROM sup WINDOW w AS (PARTITION BY chan ORDER BY i))")
def fir_filter(spark, d):
    return _out(cleaning.fir(supplier_series(spark, d), ["chan"], [0.5, 0.3, 0.2]))


ZS = "zs AS (SELECT chan, i, 60 * (x - AVG(x) OVER w) / STDDEV_POP(x) OVER w AS x FROM sup WINDOW w AS (PARTITION BY chan))"


def _standard(spark, d):
    """Supplier series standardised to a deviation of 60."""
    z = series.zscore(supplier_series(spark, d), ["chan"], out="z")
    return z.select("chan", F.col("i").cast("long").alias("i"), (60 * F.col("z")).alias("x"))


@query(with_(SUP, ZS) + "SELECT chan, COUNT(*) AS crossings, SUM(i)::BIGINT AS places FROM (SELECT chan, i, x, LEAD(x) OVER (PARTITION BY chan ORDER BY i) AS n FROM zs) WHERE n IS NOT NULL AND (x > 0) <> (n > 0) GROUP BY 1")
def zero_crossings(spark, d):
    z = series.zero_crossings(_standard(spark, d), ["chan"])
    return z.groupBy("chan").agg(F.count("*").alias("crossings"), F.sum("i").alias("places"))


EXT = """isl AS (SELECT chan, i, x, SUM(n) OVER (PARTITION BY chan ORDER BY i) AS g FROM (SELECT chan, i, x, CASE WHEN x = LAG(x) OVER (PARTITION BY chan ORDER BY i) THEN 0 ELSE 1 END AS n FROM zs)),
il AS (SELECT chan, g, MIN(i) AS a, MAX(i) AS b, MIN(x) AS x FROM isl GROUP BY 1, 2),
ext AS (SELECT chan, (a + b) // 2 AS i, x, CASE WHEN x > p AND x > n THEN 'peak' WHEN x < p AND x < n THEN 'trough' END AS kind
  FROM (SELECT *, LAG(x) OVER (PARTITION BY chan ORDER BY g) AS p, LEAD(x) OVER (PARTITION BY chan ORDER BY g) AS n FROM il) WHERE (x > p AND x > n) OR (x < p AND x < n))"""


@query(with_(SUP, ZS, EXT) + "SELECT chan, i::BIGINT AS i, ROUND(x, 6) + 0.0 AS x, kind FROM ext WHERE CASE WHEN kind = 'peak' THEN x ELSE -x END BETWEEN 10 AND 150")
def local_extrema(spark, d):
    """Peaks of 10 to 150 and troughs as deep."""
    e = series.local_extrema(_standard(spark, d), ["chan"], low=10.0, high=150.0)
    return e.select("chan", F.col("i").cast("long").alias("i"), rnd(F.col("x")).alias("x"), "kind")


CROSS = """cr AS (SELECT chan, i, x, CASE WHEN (x > 0) <> (LEAD(x) OVER (PARTITION BY chan ORDER BY i) > 0) THEN i END AS c FROM zs),
mk AS (SELECT chan, i, x, MAX(c) OVER (PARTITION BY chan ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
  MIN(c) OVER (PARTITION BY chan ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nc FROM cr)"""


@query(
    with_(
        SUP,
        ZS,
        EXT,
        CROSS,
        """neg AS (SELECT chan, i, x, pc, nc FROM ext JOIN mk USING (chan, i, x) WHERE kind = 'trough' AND -x BETWEEN 20 AND 300),
pos AS (SELECT chan, i, x, pc, nc FROM ext JOIN mk USING (chan, i, x) WHERE kind = 'peak' AND x BETWEEN 10 AND 300),
pair AS (SELECT n.chan, n.pc AS start, n.i AS neg_peak, n.nc AS mid, p.i AS pos_peak, p.nc AS stop, n.x AS vn, p.x AS vp
  FROM neg n JOIN (SELECT n.chan, n.i, MIN(p.i) AS pi FROM neg n JOIN pos p ON p.chan = n.chan AND p.i > n.i GROUP BY 1, 2) m ON m.chan = n.chan AND m.i = n.i JOIN pos p ON p.chan = n.chan AND p.i = m.pi),
good AS (SELECT * FROM pair WHERE -vn + vp > 40 AND -vn + vp < 700 AND (mid - start) / 4.0 > 0.3 AND (mid - start) / 4.0 < 1.5 AND (stop - mid) / 4.0 > 0.1 AND (stop - mid) / 4.0 < 1.5
  AND start < neg_peak AND neg_peak < mid AND mid < pos_peak AND pos_peak < stop AND -vn / NULLIF((mid - neg_peak) / 4.0, 0) > 0),
one AS (SELECT * FROM good WHERE (chan, start) IN (SELECT (chan, start) FROM good GROUP BY chan, start HAVING COUNT(*) = 1))""",
    )
    + """SELECT chan, start, neg_peak, mid, pos_peak, stop, ROUND(-vn + vp, 6) + 0.0 AS ptp, ROUND((stop - start) / 4.0, 6) + 0.0 AS duration, ROUND(-vn / ((mid - neg_peak) / 4.0), 6) + 0.0 AS slope
FROM one WHERE (chan, stop) IN (SELECT (chan, stop) FROM one GROUP BY chan, stop HAVING COUNT(*) = 1)"""
)
def slow_waves(spark, d):
    """Slow waves in series taken at 4 Hz."""
    w = events.slow_waves(_standard(spark, d), ["chan"], 4.0, (20, 300), (10, 300), (40, 700), (0.3, 1.5), (0.1, 1.5))
    return w.select("chan", "start", "neg_peak", "mid", "pos_peak", "stop", *(rnd(F.col(c)).alias(c) for c in ("ptp", "duration", "slope")))


@query(
    with_(
        SUP,
        ZS,
        EXT,
        CROSS,
        """e2 AS (SELECT *, LAG(i) OVER (PARTITION BY chan ORDER BY i) AS eb, LEAD(i) OVER (PARTITION BY chan ORDER BY i) AS ea FROM ext),
lim AS (SELECT chan, MIN(i) AS lo, MAX(i) AS hi FROM zs GROUP BY 1),
pk AS (SELECT chan, i AS peak, x AS amp, GREATEST(COALESCE(pc, lo), COALESCE(eb, lo)) AS start, LEAST(COALESCE(nc, hi), COALESCE(ea, hi)) AS stop
  FROM e2 JOIN mk USING (chan, i, x) JOIN lim USING (chan) WHERE kind = 'peak' AND i > 20 AND i < 400)""",
    )
    + 'SELECT pk.chan, peak AS "at", ROUND(amp, 6) + 0.0 AS amplitude, start, stop, ROUND(SUM(zs.x), 4) + 0.0 AS area FROM pk JOIN zs ON zs.chan = pk.chan AND zs.i > start AND zs.i <= stop GROUP BY pk.chan, peak, amp, start, stop'
)
def evoked_peaks(spark, d):
    """Peaks between samples 20 and 400 with their extent and area."""
    p = events.evoked_peaks(_standard(spark, d), ["chan"], "peak", (20, 400))
    return p.select("chan", "at", rnd(F.col("amplitude")).alias("amplitude"), "start", "stop", rnd(F.col("area"), 4).alias("area"))


@query(
    with_(
        SUP,
        ZS,
        EXT,
        """m AS (SELECT chan, zs.i, CASE kind WHEN 'peak' THEN 0.5 WHEN 'trough' THEN 0.0 END AS ph, CASE WHEN kind IS NOT NULL THEN zs.i END AS e FROM zs LEFT JOIN ext USING (chan, i)),
b AS (SELECT chan, i, MAX(e) OVER (PARTITION BY chan ORDER BY i) AS a, MIN(e) OVER (PARTITION BY chan ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM m)""",
    )
    + "SELECT b.chan, b.i::BIGINT AS i, ROUND(CASE WHEN z IS NOT NULL THEN m.ph + 0.5 * (b.i - a) / (z - a) END, 6) + 0.0 AS y FROM b LEFT JOIN m ON m.chan = b.chan AND m.i = b.a"
)
def extrema_phase(spark, d):
    """Phase between troughs and peaks."""
    return _out(events.phase(_standard(spark, d), ["chan"]), "phase")


WALK = """nn AS (SELECT chan, i, x - AVG(x) OVER (PARTITION BY chan) AS c, COUNT(*) OVER (PARTITION BY chan) AS n FROM sup),
wk AS (SELECT chan, i, n, SUM(c) OVER (PARTITION BY chan ORDER BY i) AS y FROM nn)"""


def _scales(least, factor):
    return f"""sc AS (SELECT DISTINCT chan, n, FLOOR({least} * POWER({factor}, k))::BIGINT AS scale FROM (SELECT chan, n, UNNEST(range(0, FLOOR(LN(n * 0.1 / {least}) / LN({factor}))::BIGINT + 1)) AS k FROM (SELECT DISTINCT chan, n FROM wk WHERE n * 0.1 >= {least}))),
blk AS (SELECT wk.chan, scale, wk.i // scale AS b, (regr_syy(y, i) - POWER(regr_sxy(y, i), 2) / regr_sxx(y, i)) / scale AS v FROM wk JOIN sc USING (chan) WHERE wk.i // scale < wk.n // scale GROUP BY 1, 2, 3)"""


@query(
    with_(SUP, WALK, _scales(4, 1.2), "fl AS (SELECT chan, scale, SQRT(AVG(GREATEST(v, 0))) AS f FROM blk GROUP BY 1, 2)")
    + "SELECT chan, ROUND(regr_slope(LN(f), LN(scale)), 6) + 0.0 AS alpha FROM fl WHERE f > 0 GROUP BY 1"
)
def dfa(spark, d):
    """Detrended fluctuation analysis of each supplier's prices."""
    return series.dfa(supplier_series(spark, d), ["chan"]).select("chan", rnd(F.col("alpha")).alias("alpha"))


QS = [k / 2 for k in range(-10, 11)]
MF = with_(
    SUP,
    WALK,
    _scales(10, 1.25),
    f"qs AS (SELECT UNNEST({QS}::DOUBLE[]) AS q)",
    """fq AS (SELECT chan, q, scale, CASE WHEN q = 0 THEN EXP(AVG(LN(v)) FILTER (v > 1e-20) / 2) ELSE POWER(AVG(POWER(v, q / 2)) FILTER (v > 0), 1 / NULLIF(q, 0)) END AS f FROM blk, qs GROUP BY 1, 2, 3),
h AS (SELECT chan, q, regr_slope(LOG10(f), LOG10(scale)) AS h FROM fq WHERE f > 0 GROUP BY 1, 2)""",
)


@query(MF + "SELECT chan, q, ROUND(h, 5) + 0.0 AS h FROM h")
def mfdfa(spark, d):
    """Generalised Hurst exponents."""
    return series.mfdfa(supplier_series(spark, d), ["chan"], QS).select("chan", "q", rnd(F.col("h"), 5).alias("h"))


@query(
    MF
    + """, g AS (SELECT chan, q, h, (COALESCE(LEAD(h) OVER w, h) - COALESCE(LAG(h) OVER w, h)) / (COALESCE(LEAD(q) OVER w, q) - COALESCE(LAG(q) OVER w, q)) AS dh FROM h WINDOW w AS (PARTITION BY chan ORDER BY q))
SELECT chan, ROUND(MAX(h) FILTER (q = 2), 5) + 0.0 AS h2, ROUND(MAX(h + q * dh) - MIN(h + q * dh), 5) + 0.0 AS width, ROUND(MAX(h + q * dh) FILTER (q = 0), 5) + 0.0 AS alpha0 FROM g GROUP BY 1"""
)
def mf_spectrum(spark, d):
    """Width and centre of the multifractal spectrum."""
    m = series.mf_spectrum(series.mfdfa(supplier_series(spark, d), ["chan"], QS), ["chan"])
    return m.select("chan", *(rnd(F.col(c), 5).alias(c) for c in ("h2", "width", "alpha0")))


@query(
    with_(SUP)
    + "SELECT chan, ROUND(AVG(x), 6) + 0.0 AS trimmed FROM (SELECT chan, x, ROW_NUMBER() OVER (PARTITION BY chan ORDER BY x) AS r, COUNT(*) OVER (PARTITION BY chan) AS n FROM sup) WHERE r > FLOOR(n * 0.1) AND r <= n - FLOOR(n * 0.1) GROUP BY 1"
)
def trimmed_mean(spark, d):
    t = series.trimmed_mean(supplier_series(spark, d), ["chan"])
    return t.select("chan", rnd(F.col("trimmed")).alias("trimmed"))


@query(with_(SUP) + "SELECT chan, ROUND((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.35, 6) + 0.0 AS sigma FROM sup GROUP BY 1")
def robust_sigma(spark, d):
    return supplier_series(spark, d).groupBy("chan").agg(rnd(series.robust_sigma()).alias("sigma"))


@query(with_(SUP) + f"SELECT chan, ROUND(list_avg(quantile_cont(x, {[k / 100 for k in range(30, 70)]})), 6) + 0.0 AS m FROM sup GROUP BY 1")
def percentile_mean(spark, d):
    return supplier_series(spark, d).groupBy("chan").agg(rnd(series.percentile_mean()).alias("m"))


@query(with_(SUP) + "SELECT chan, SUM((x > m)::INT)::BIGINT AS ones, COUNT(*) AS n FROM (SELECT *, AVG(x) OVER (PARTITION BY chan) AS m FROM sup) GROUP BY 1")
def binarise(spark, d):
    b = series.binarise(supplier_series(spark, d), ["chan"])
    return b.groupBy("chan").agg(F.sum("bit").alias("ones"), F.count("*").alias("n"))


@query(with_(SUP) + "SELECT chan, LEAST(9, FLOOR(x / 10000))::INT AS bin, COUNT(*) AS n FROM sup GROUP BY 1, 2")
def histogram(spark, d):
    b = F.least(F.lit(9), F.floor(F.col("x") / 10000)).cast("int").alias("bin")
    return supplier_series(spark, d).groupBy("chan", b).agg(F.count("*").alias("n"))


@query(
    with_(SUP, ZS)
    + """SELECT time AS window, GREATEST(SUM((z > 2)::INT), SUM((z < -2)::INT)) > FLOOR(COUNT(*) * 0.1) AS bad FROM (
SELECT chan, time, (rms - quantile_cont(rms, 0.5) OVER (PARTITION BY chan)) / NULLIF((quantile_cont(rms, 0.75) OVER (PARTITION BY chan) - quantile_cont(rms, 0.25) OVER (PARTITION BY chan)) / 1.35, 0) AS z
FROM (SELECT chan, i // 32 AS time, SQRT(AVG(x * x)) AS rms FROM zs GROUP BY 1, 2)) GROUP BY 1"""
)
def clean_window_mask(spark, d):
    """Windows of 32 samples that more than a tenth of the channels leave by two robust deviations."""
    return cleaning.window_mask(_standard(spark, d), [], "chan", 32, -2.0, 2.0, 0.1)


TYPES = "v AS (SELECT * FROM evt WHERE chan = (SELECT MIN(chan) FROM evt)), c AS (SELECT * FROM evt WHERE chan = (SELECT MAX(chan) FROM evt))"


@query(
    with_(EVT, TYPES)
    + "SELECT v.event_id, ROUND(c.x, 6) + 0.0 AS last_x FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.t >= c.t"
)
def asof_backward(spark, d):
    """For each event of the first type, the user's last value of the last type."""
    left, right = _two_types(spark, d)
    out = joins.asof_join(left, right, "t", ["user_id"], ["last_x"])
    return out.select("event_id", rnd(F.col("last_x")).alias("last_x"))


def _two_types(spark, d):
    e = event_series(spark, d)
    first, last = e.agg(F.min("chan"), F.max("chan")).first()
    left = e.where(F.col("chan") == first).select("user_id", "t", "event_id")
    return left, e.where(F.col("chan") == last).select("user_id", "t", F.col("x").alias("last_x"))


@query(
    with_(EVT, TYPES)
    + "SELECT v.event_id, ROUND(c.x, 6) + 0.0 AS last_x FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.t <= c.t"
)
def asof_forward(spark, d):
    left, right = _two_types(spark, d)
    out = joins.asof_join(left, right, "t", ["user_id"], ["last_x"], forward=True)
    return out.select("event_id", rnd(F.col("last_x")).alias("last_x"))


@query(
    with_(EVT, TYPES)
    + """, b AS (SELECT v.event_id, v.user_id, v.t, c.t AS t0, c.x AS v0 FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.t >= c.t)
SELECT b.event_id, ROUND(CASE WHEN t0 = c.t THEN v0 ELSE v0 + (c.x - v0) * (b.t - t0) / (c.t - t0) END, 4) + 0.0 AS last_x FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.t <= c.t"""
)
def interp_join(spark, d):
    """Values of the last type interpolated at the times of the first."""
    left, right = _two_types(spark, d)
    out = joins.interpolate_join(left, right, "t", ["user_id"], "last_x")
    return out.select("event_id", rnd(F.col("last_x"), 4).alias("last_x"))


@query(
    with_(EVT)
    + "SELECT m.event_id, COUNT(*) AS n, ROUND(AVG(s.x), 6) + 0.0 AS mean FROM evt m JOIN evt s ON s.user_id = m.user_id AND s.t BETWEEN m.t - 21600 AND m.t + 21600 WHERE m.chan = (SELECT MIN(chan) FROM evt) GROUP BY 1"
)
def event_epoch_range_join(spark, d):
    """Samples of a user within six hours of each marker."""
    markers, _ = _two_types(spark, d)
    e = event_series(spark, d).select("user_id", "t", "x")
    out = segment.event_epochs(e, markers.withColumnRenamed("t", "onset"), 21600.0, 21600.0, ["user_id"])
    return out.groupBy("event_id").agg(F.count("*").alias("n"), rnd(F.avg("x")).alias("mean"))


@query(
    with_(EVT)
    + """, g AS (SELECT chan, UNNEST(range(FLOOR(MIN(t) / 3600)::BIGINT, FLOOR(MAX(t) / 3600)::BIGINT + 1)) AS h FROM evt GROUP BY 1),
m AS (SELECT chan, FLOOR(t / 3600)::BIGINT AS h, AVG(x) AS x FROM evt GROUP BY 1, 2)
SELECT chan, h * 3600.0::DOUBLE AS t, ROUND(COALESCE(x, 0), 6) + 0.0 AS x FROM g LEFT JOIN m USING (chan, h)"""
)
def gap_fill_grid(spark, d):
    """Hourly means with zeros for hours without samples."""
    g = segment.fill_grid(event_series(spark, d).select("chan", "t", "x"), ["chan"], 3600.0, "x", 0.0)
    return g.select("chan", F.col("t").cast("double").alias("t"), rnd(F.col("x")).alias("x"))


BEATS = "bt AS (SELECT user_id, t, event_id, 700 + x AS rr FROM evt)"


def _beats(spark, d):
    return event_series(spark, d).select("user_id", "t", "event_id", (700 + F.col("x")).alias("rr"))


@query(
    with_(EVT, BEATS)
    + """SELECT user_id, COUNT(*) AS n, ROUND(AVG(rr), 6) + 0.0 AS mean_rr, ROUND(STDDEV_SAMP(rr), 6) + 0.0 AS sdnn, ROUND(SQRT(AVG(s * s)), 6) + 0.0 AS rmssd, ROUND(100.0 * SUM((ABS(s) > 50)::INT) / NULLIF(COUNT(s), 0), 6) + 0.0 AS pnn50
FROM (SELECT user_id, rr, rr - LAG(rr) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM bt) GROUP BY 1"""
)
def hrv_time_domain(spark, d):
    h = cardiac.hrv_time(_beats(spark, d), ["user_id"], "t")
    return h.select("user_id", "n", *(rnd(F.col(c)).alias(c) for c in ("mean_rr", "sdnn", "rmssd", "pnn50")))


@query(
    with_(EVT, BEATS)
    + """, bs AS (SELECT user_id, rr AS y, SUM(rr) OVER (PARTITION BY user_id ORDER BY t, event_id) / 1000 AS s FROM bt),
mn AS (SELECT user_id, AVG(y) AS m FROM bs GROUP BY 1 HAVING COUNT(*) >= 5),
ph AS (SELECT user_id, k, 2 * PI() * 0.005 * k AS w, ATAN2(SUM(SIN(2 * 2 * PI() * 0.005 * k * s)), SUM(COS(2 * 2 * PI() * 0.005 * k * s))) / 2 AS h FROM bs JOIN mn USING (user_id), range(1, 101) g(k) GROUP BY 1, 2),
pw AS (SELECT user_id, k, 0.5 * (SUM((y - m) * COS(w * s - h)) ** 2 / SUM(COS(w * s - h) ** 2) + SUM((y - m) * SIN(w * s - h)) ** 2 / SUM(SIN(w * s - h) ** 2)) AS p FROM bs JOIN mn USING (user_id) JOIN ph USING (user_id) GROUP BY 1, 2),
bd AS (SELECT user_id, SUM(p) FILTER (WHERE k < 8) * 0.005 AS vlf, SUM(p) FILTER (WHERE k BETWEEN 8 AND 29) * 0.005 AS lf, SUM(p) FILTER (WHERE k BETWEEN 30 AND 79) * 0.005 AS hf, SUM(p) FILTER (WHERE k BETWEEN 80 AND 99) * 0.005 AS vhf FROM pw GROUP BY 1)
SELECT user_id, ROUND(LN(vlf), 5) + 0.0 AS vlf, ROUND(LN(lf), 5) + 0.0 AS lf, ROUND(LN(hf), 5) + 0.0 AS hf, ROUND(LN(vhf), 5) + 0.0 AS vhf, ROUND(lf / hf, 5) + 0.0 AS lf_hf, ROUND(lf / (lf + hf), 6) + 0.0 AS lf_share FROM bd"""
)
def hrv_frequency(spark, d):
    """Band powers (as logarithms) of the intervals' periodogram."""
    h = cardiac.hrv_frequency(_beats(spark, d), ["user_id"], ["t", "event_id"])
    logs = [rnd(F.ln(c), 5).alias(c) for c in cardiac.HRV_BANDS]
    return h.select("user_id", *logs, rnd(F.col("lf_hf"), 5).alias("lf_hf"), rnd(F.col("lf_share")).alias("lf_share"))


@query(
    with_(EVT, BEATS)
    + """, nb AS (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS b, rr FROM bt),
em AS (SELECT * FROM (SELECT user_id, b // 128 AS win, b, rr AS v0, LEAD(rr) OVER w AS v1 FROM nb WINDOW w AS (PARTITION BY user_id, b // 128 ORDER BY b)) WHERE v1 IS NOT NULL),
ct AS (SELECT user_id, win, COUNT(*) AS n FROM em GROUP BY ALL HAVING COUNT(*) >= 2),
pr AS (SELECT x.user_id, x.win, x.b, y.b - x.b AS apart FROM em x JOIN em y ON x.user_id = y.user_id AND x.win = y.win AND x.b < y.b AND ABS(x.v0 - y.v0) <= 40 AND ABS(x.v1 - y.v1) <= 40),
rn AS (SELECT user_id, win, apart, COUNT(*) AS len FROM (SELECT *, b - ROW_NUMBER() OVER (PARTITION BY user_id, win, apart ORDER BY b) AS run FROM pr) GROUP BY user_id, win, apart, run),
ln AS (SELECT user_id, win, len, COUNT(*) AS c FROM rn GROUP BY ALL),
tt AS (SELECT user_id, win, SUM(len * c) AS points, SUM(len * c) FILTER (WHERE len >= 2) AS on_lines, SUM(c) FILTER (WHERE len >= 2) AS c, MAX(len) FILTER (WHERE len >= 2) AS longest FROM ln GROUP BY ALL),
en AS (SELECT user_id, win, -SUM(l.c / t.c * LN(l.c / t.c)) AS e FROM ln l JOIN tt t USING (user_id, win) WHERE l.len >= 2 GROUP BY ALL)
SELECT user_id, win, n, ROUND(COALESCE(points, 0) / (n * (n - 1) / 2), 6) + 0.0 AS recurrence_rate, ROUND(COALESCE(on_lines, 0) / points, 6) + 0.0 AS determinism, ROUND(on_lines / c, 6) + 0.0 AS mean_line, longest AS longest_line, ROUND(e, 6) + 0.0 AS line_entropy
FROM ct LEFT JOIN tt USING (user_id, win) LEFT JOIN en USING (user_id, win)"""
)
def hrv_recurrence(spark, d):
    """Recurrence measures of pairs of intervals in windows of 128 beats."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    b = _beats(spark, d).withColumn("b", place).withColumn("win", F.floor(F.col("b") / 128))
    out = cardiac.recurrence(b, ["user_id", "win"], ["b"], 40.0, dimension=2)
    return out.select("user_id", "win", "n", *(rnd(F.col(c)).alias(c) for c in ("recurrence_rate", "determinism", "mean_line")), "longest_line", rnd(F.col("line_entropy")).alias("line_entropy"))


PC = """SELECT {k}, ROUND(sd1, 6) + 0.0 AS sd1, ROUND(sd2, 6) + 0.0 AS sd2, ROUND(sd2 / NULLIF(sd1, 0), 6) + 0.0 AS csi, ROUND(CASE WHEN sd1 * sd2 > 0 THEN LOG10(sd1 * sd2) END, 6) + 0.0 AS cvi FROM (
SELECT {k}, SQRT(0.5 * VAR_SAMP(s)) AS sd1, CASE WHEN 2 * VAR_SAMP(rr) - 0.5 * VAR_SAMP(s) > 0 THEN SQRT(2 * VAR_SAMP(rr) - 0.5 * VAR_SAMP(s)) END AS sd2
FROM (SELECT {k}, rr, LEAD(rr) OVER (PARTITION BY {k} ORDER BY t) - rr AS s FROM {src}) GROUP BY {k} HAVING COUNT(*) >= 5)"""


@query(with_(EVT, BEATS) + PC.format(k="user_id", src="bt"))
def poincare_hrv(spark, d):
    p = cardiac.poincare(_beats(spark, d), ["user_id"], "t")
    return p.select("user_id", *(rnd(F.col(c)).alias(c) for c in ("sd1", "sd2", "csi", "cvi")))


@query(
    with_(
        EVT,
        BEATS,
        "en AS (SELECT user_id, MIN(t) AS a, MAX(t) AS b FROM bt GROUP BY 1 HAVING MAX(t) - MIN(t) >= 259200)",
        "st AS (SELECT user_id, a + k * 86400 AS start FROM (SELECT user_id, a, UNNEST(range(0, FLOOR((b - a - 259200) / 86400)::BIGINT + 1)) AS k FROM en))",
        "inw AS (SELECT st.user_id, st.start, t, rr FROM st JOIN bt ON bt.user_id = st.user_id AND bt.t BETWEEN st.start AND st.start + 259200)",
    )
    + "SELECT user_id, ROUND(start, 3) AS start, sd1, sd2, csi, cvi FROM ("
    + PC.format(k="user_id, start", src="inw")
    + ")"
)
def sliding_hrv(spark, d):
    """Poincaré measures in windows of three days, every day."""
    p = cardiac.sliding_poincare(_beats(spark, d), ["user_id"], 259200.0, 86400.0)
    return p.select("user_id", F.round("start", 3).alias("start"), *(rnd(F.col(c)).alias(c) for c in ("sd1", "sd2", "csi", "cvi")))


QUAD = """q AS (SELECT user_id, CASE WHEN px >= 0 AND py >= 0 THEN 1 WHEN px < 0 AND py > 0 THEN 2 WHEN px <= 0 AND py <= 0 THEN 3 WHEN px > 0 AND py < 0 THEN 4 END AS quadrant, px, py FROM (
  SELECT user_id, rr - LEAD(rr) OVER w AS px, LEAD(rr) OVER w - LEAD(rr, 2) OVER w AS py FROM bt WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE py IS NOT NULL)"""


@query(
    with_(EVT, BEATS, QUAD)
    + "SELECT user_id, quadrant, COUNT(*) AS n, ROUND(AVG(px), 6) + 0.0 AS mean_x, ROUND(AVG(py), 6) + 0.0 AS mean_y, ROUND(2 * STDDEV_POP(SQRT(px * px + py * py)), 6) + 0.0 AS spread FROM q WHERE quadrant IS NOT NULL GROUP BY 1, 2"
)
def quadrant_hrv(spark, d):
    q = cardiac.quadrants(_beats(spark, d), ["user_id"], "t")
    return q.select("user_id", "quadrant", "n", *(rnd(F.col(c)).alias(c) for c in ("mean_x", "mean_y", "spread")))


@query(
    with_(EVT, BEATS, QUAD)
    + """, c AS (SELECT user_id, COUNT(*) FILTER (quadrant = 1) AS n1, COUNT(*) FILTER (quadrant = 2) AS n2, COUNT(*) FILTER (quadrant = 3) AS n3, COUNT(*) FILTER (quadrant = 4) AS n4 FROM q WHERE quadrant IS NOT NULL GROUP BY 1),
l AS (SELECT user_id, n2 - n4 AS arrest, n3 - n1 AS acceleration, UNNEST([GREATEST(1, n1), GREATEST(1, n2), GREATEST(1, n3), GREATEST(1, n4)]) AS h FROM c)
SELECT user_id, ANY_VALUE(arrest) AS arrest, ANY_VALUE(acceleration) AS acceleration, ROUND(SUM(-(h / w) * LOG2(h / w)), 6) + 0.0 AS entropy FROM (SELECT *, SUM(h) OVER (PARTITION BY user_id) AS w FROM l) GROUP BY 1"""
)
def quadrant_summary(spark, d):
    q = cardiac.quadrant_summary(_beats(spark, d), ["user_id"], "t")
    return q.select("user_id", "arrest", "acceleration", rnd(F.col("entropy")).alias("entropy"))


DZ = DAY + ",\nzs AS (SELECT chan, i, x - AVG(x) OVER (PARTITION BY chan) AS x FROM day)"


@query(
    with_(DZ, EXT)
    + """SELECT chan, trough, peak, next_trough, ROUND(rise, 6) + 0.0 AS rise, inspiration, expiration FROM (SELECT chan, kind, i::BIGINT AS trough, LEAD(i) OVER w::BIGINT AS peak, LEAD(i, 2) OVER w::BIGINT AS next_trough, LEAD(kind) OVER w AS nk,
LEAD(x) OVER w - x AS rise, (LEAD(i) OVER w - i)::BIGINT AS inspiration, (LEAD(i, 2) OVER w - LEAD(i) OVER w)::BIGINT AS expiration FROM ext WINDOW w AS (PARTITION BY chan ORDER BY i)) WHERE kind = 'trough' AND nk = 'peak' AND next_trough IS NOT NULL"""
)
def resp_cycles(spark, d):
    """Breath-like cycles of the daily series."""
    s = series.with_stats(daily_series(spark, d), ["chan"], mean=F.avg("x"))
    s = s.select("chan", F.col("i").cast("long").alias("i"), (F.col("x") - F.col("mean")).alias("x"))
    c = cardiac.breath_cycles(s, ["chan"])
    return c.select("chan", "trough", "peak", "next_trough", rnd(F.col("rise")).alias("rise"), "inspiration", "expiration")


@query(
    with_(EVT, "v AS (SELECT * FROM evt WHERE chan = (SELECT MIN(chan) FROM evt)), c AS (SELECT user_id, t, x FROM evt WHERE chan = (SELECT MAX(chan) FROM evt))")
    + """SELECT v.event_id, ROUND(a.x, 6) + 0.0 AS lag0, ROUND(b.x, 6) + 0.0 AS lag1 FROM v ASOF LEFT JOIN c a ON v.user_id = a.user_id AND v.t >= a.t
ASOF LEFT JOIN (SELECT user_id, t + 86400 AS t, x FROM c) b ON v.user_id = b.user_id AND v.t >= b.t"""
)
def lag_design(spark, d):
    """Values of one series at the times of another and a day before."""
    left, right = _two_types(spark, d)
    out = cardiac.lag_design(left, right.withColumnRenamed("last_x", "x"), ["user_id"], [0.0, 86400.0])
    return out.select("event_id", rnd(F.col("lag0")).alias("lag0"), rnd(F.col("lag1")).alias("lag1"))


@query(with_(EVT) + "SELECT chan, CASE WHEN ABS(quantile_cont(x, 0.15)) > ABS(quantile_cont(x, 0.85)) THEN -1 ELSE 1 END AS sign FROM evt GROUP BY 1")
def signal_polarity(spark, d):
    return cardiac.polarity(event_series(spark, d), ["chan"])


@query(
    with_(EVT)
    + """, s AS (SELECT user_id, event_id, chan, t, CASE WHEN chan = LAG(chan) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS n FROM evt),
g AS (SELECT *, SUM(n) OVER (PARTITION BY user_id ORDER BY t) AS g FROM s)
SELECT user_id, chan, ROUND(MIN(t), 3) AS first, ROUND(MAX(t), 3) AS last, COUNT(*) AS n FROM g GROUP BY user_id, chan, g"""
)
def state_runs(spark, d):
    """Stretches of one type of event per user."""
    r = events.runs(event_series(spark, d), ["user_id"], "chan", "t")
    return r.select("user_id", "chan", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "n")
