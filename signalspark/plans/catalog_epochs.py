"""Queries on short epochs held as arrays: spectra, aperiodic fits, complexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalspark.functions import kernels
from signalspark.functions import nonlinear as nl
from signalspark.functions import spectral as sp
from signalspark.functions.arrays import center, let, rnd, simpson, variance
from signalspark.operators import segment, series
from signalspark.plans.inputs import SIG, SRATE, N, epochs, samples, with_
from signalspark.plans.registry import query
from signalspark.schema import BANDS

STEP = SRATE / N
PSD = (
    SIG
    + """,
cen AS (SELECT vec_id, i, (x - AVG(x) OVER (PARTITION BY vec_id)) * (0.54 - 0.46 * COS(2 * PI() * i / 64)) AS s FROM sig),
ks AS (SELECT UNNEST(range(0, 33)) AS k),
dft AS (SELECT vec_id, k, SUM(s * COS(2 * PI() * ((k * i) % 64) / 64)) AS re, SUM(s * SIN(2 * PI() * ((k * i) % 64) / 64)) AS im FROM cen, ks GROUP BY 1, 2),
wss AS (SELECT SUM(POWER(0.54 - 0.46 * COS(2 * PI() * j / 64), 2)) AS w FROM (SELECT UNNEST(range(0, 64)) AS j)),
psd AS (SELECT vec_id, k, (re * re + im * im) * CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END / (64 * w) AS p FROM dft, wss)"""
)
BAND_ROWS = ", ".join(f"({a}, {b}, '{n}')" for a, b, n in BANDS)


def spectra(spark, d):
    """(vec_id, p): spectra in 33 bins of 1 Hz. Computed once per epoch, without a shuffle."""
    return kernels.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"p": kernels.welch(x, SRATE, N)[1]}, "p array<double>")


def _bands(p):
    return F.explode(F.array(*(F.struct(F.lit(n).alias("band"), sp.band_power(p, STEP, a, b).alias("power")) for a, b, n in BANDS)))


@query(with_(PSD) + "SELECT vec_id, k::BIGINT AS k, ROUND(p, 6) + 0.0 AS p FROM psd")
def periodogram_dft(spark, d):
    """Density of each epoch by frequency bin."""
    p = epochs(spark, d).select("vec_id", sp.periodogram(F.col("x"), N, SRATE).alias("p"))  # the direct sum, no Python
    return p.select("vec_id", F.posexplode("p").alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), rnd(F.col("p")).alias("p"))


BANDPOWER = (
    PSD
    + f""",
bands(lo, hi, band) AS (VALUES {BAND_ROWS}),
bp AS (SELECT vec_id, band, SUM((p + q) / 2) AS power FROM (
  SELECT vec_id, band, p, LAG(p) OVER (PARTITION BY vec_id, band ORDER BY k) AS q FROM psd JOIN bands ON k BETWEEN lo AND hi) GROUP BY 1, 2),
tot AS (SELECT vec_id, SUM((p + q) / 2) AS whole FROM (SELECT vec_id, p, LAG(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM psd WHERE k BETWEEN 1 AND 40) GROUP BY 1)"""
)


@query(with_(BANDPOWER) + "SELECT vec_id, band, ROUND(power / whole, 6) + 0.0 AS power FROM bp JOIN tot USING (vec_id)")
def bandpower_relative(spark, d):
    """Share of each band in the power between the lowest and highest band edge."""
    whole = sp.band_power(F.col("p"), STEP, BANDS[0][0], max(b[1] for b in BANDS))
    rows = spectra(spark, d).select("vec_id", whole.alias("whole"), _bands(F.col("p")).alias("b"))
    return rows.select("vec_id", "b.band", rnd(F.try_divide("b.power", "whole")).alias("power"))


@query(with_(BANDPOWER) + "SELECT vec_id, band, ROUND(power, 6) + 0.0 AS power FROM bp")
def bandpower_absolute(spark, d):
    """Power of each band."""
    return spectra(spark, d).select("vec_id", _bands(F.col("p")).alias("b")).select("vec_id", "b.band", rnd(F.col("b.power")).alias("power"))


@query(with_(BANDPOWER) + "SELECT vec_id, ROUND(LOG10(whole), 6) + 0.0 AS total FROM tot")
def total_power_log(spark, d):
    """log10 of the power over all bands."""
    return spectra(spark, d).select("vec_id", rnd(F.log10(sp.band_power(F.col("p"), STEP, 1.0, 40.0))).alias("total"))


@query(
    with_(BANDPOWER)
    + """SELECT vec_id, ROUND(MAX(power) FILTER (band = 'Alpha') / MAX(power) FILTER (band = 'Theta'), 6) + 0.0 AS at,
ROUND(MAX(power) FILTER (band = 'Delta') / MAX(power) FILTER (band = 'Theta'), 6) + 0.0 AS dt,
ROUND(MAX(power) FILTER (band = 'Delta') / MAX(power) FILTER (band = 'Alpha'), 6) + 0.0 AS da,
ROUND(MAX(power) FILTER (band = 'Alpha') / MAX(power) FILTER (band = 'Beta1'), 6) + 0.0 AS ab FROM bp GROUP BY vec_id"""
)
def band_ratios(spark, d):
    """Ratios of band powers, null for a band without power."""
    power = {n: sp.band_power(F.col("p"), STEP, a, b) for a, b, n in BANDS}
    rows = spectra(spark, d).select("vec_id", *(power[n].alias(n) for n in ("Delta", "Theta", "Alpha", "Beta1")))
    pairs = {"at": ("Alpha", "Theta"), "dt": ("Delta", "Theta"), "da": ("Delta", "Alpha"), "ab": ("Alpha", "Beta1")}
    return rows.select("vec_id", *(rnd(F.try_divide(a, b)).alias(k) for k, (a, b) in pairs.items()))


@query(
    with_(PSD)
    + "SELECT vec_id, MIN(k - 1)::BIGINT AS edge FROM (SELECT vec_id, k, SUM(p) OVER (PARTITION BY vec_id ORDER BY k) AS c, SUM(p) OVER (PARTITION BY vec_id) AS t FROM psd WHERE k BETWEEN 1 AND 30) WHERE c >= 0.5 * t GROUP BY 1"
)
def spectral_edge(spark, d):
    """Bin, counted from 1 Hz, below which half of the power up to 30 Hz lies."""
    return spectra(spark, d).select("vec_id", sp.spectral_edge(sp.crop(F.col("p"), STEP, 1.0, 30.0)).cast("long").alias("edge"))


@query(
    with_(PSD)
    + """SELECT vec_id, ROUND(SUM(p * CASE WHEN k IN (1, 31) THEN 1 WHEN k % 2 = 0 THEN 4 ELSE 2 END) / 3, 6) + 0.0 AS auc
FROM psd WHERE k BETWEEN 1 AND 31 GROUP BY 1"""
)
def simpson_auc(spark, d):
    """Area under the spectrum from 1 to 31 Hz by Simpson's rule."""
    return spectra(spark, d).select("vec_id", rnd(simpson(sp.crop(F.col("p"), STEP, 1.0, 31.0))).alias("auc"))


@query(
    with_(PSD)
    + """SELECT vec_id, ROUND(regr_slope(LN(GREATEST(p, 1e-20)), LN(k)), 6) + 0.0 AS slope, ROUND(regr_intercept(LN(GREATEST(p, 1e-20)), LN(k)), 6) + 0.0 AS intercept,
ROUND(regr_r2(LN(GREATEST(p, 1e-20)), LN(k)), 6) + 0.0 AS r2 FROM psd WHERE k BETWEEN 1 AND 30 GROUP BY 1"""
)
def loglog_fit(spark, d):
    """Line through ln p and ln f."""
    fit = spectra(spark, d).select("vec_id", sp.log_fit(F.col("p"), STEP, 1.0, 30.0).alias("f"))
    return fit.select("vec_id", *(rnd(F.col(f"f.{k}")).alias(k) for k in ("slope", "intercept", "r2")))


ROUND_SQL = """f{n} AS (SELECT vec_id, regr_slope(p, f) AS b, regr_intercept(p, f) AS a FROM pts{m} GROUP BY 1),
r{n} AS (SELECT vec_id, f, p, p - b * f - a AS r, COUNT(*) OVER (PARTITION BY vec_id) AS c FROM pts{m} JOIN f{n} USING (vec_id)),
t{n} AS (SELECT vec_id, list_sort(list(r))[FLOOR(COUNT(*) * 0.7)::INT + 1] AS t FROM r{n} GROUP BY 1),
k{n} AS (SELECT vec_id, f, p, r < t AS keep, SUM((r < t)::INT) OVER (PARTITION BY vec_id) AS c FROM r{n} JOIN t{n} USING (vec_id)),
pts{n} AS (SELECT vec_id, f, p FROM k{n} WHERE keep OR c < 5)"""


@query(
    with_(
        PSD,
        "pts0 AS (SELECT vec_id, LOG10(k) AS f, CASE WHEN p <= 1e-20 THEN -20 ELSE LOG10(p) END AS p FROM psd WHERE k BETWEEN 1 AND 30)",
        ROUND_SQL.format(n=1, m=0),
        ROUND_SQL.format(n=2, m=1),
    )
    + "SELECT vec_id, ROUND(-regr_slope(p, f), 6) + 0.0 AS exponent, ROUND(regr_intercept(p, f), 6) + 0.0 AS intercept FROM pts2 GROUP BY 1"
)
def aperiodic_fit_iterative(spark, d):
    """1/f line through the spectrum with peaks dropped in two rounds."""
    fit = spectra(spark, d).select("vec_id", sp.trimmed_log_fit(F.col("p"), STEP, 1.0, 30.0).alias("f"))
    return fit.select("vec_id", rnd(-F.col("f.slope")).alias("exponent"), rnd(F.col("f.intercept")).alias("intercept"))


HSET = [1.1, 1.15, 1.2, 1.25, 1.3, 1.35, 1.4, 1.45, 1.5, 1.55, 1.6, 1.65, 1.7, 1.75, 1.8, 1.85, 1.9, 1.95]


@query(
    with_(
        PSD,
        "arr AS (SELECT vec_id, list(p ORDER BY k) AS a FROM psd GROUP BY 1)",
        f"hs AS (SELECT UNNEST({HSET}) AS h)",
        "places AS (SELECT vec_id, k, h, a, LEAST(k / h, 32.0) AS lo, LEAST(k * h, 32.0) AS hi FROM arr, ks, hs)",
        """gm AS (SELECT vec_id, k, SQRT((a[FLOOR(lo)::INT + 1] + (a[LEAST(FLOOR(lo)::INT + 2, 33)] - a[FLOOR(lo)::INT + 1]) * (lo - FLOOR(lo)))
 * (a[FLOOR(hi)::INT + 1] + (a[LEAST(FLOOR(hi)::INT + 2, 33)] - a[FLOOR(hi)::INT + 1]) * (hi - FLOOR(hi)))) AS g FROM places)""",
        "ap AS (SELECT vec_id, k, list_sort(list(g))[10] AS ap FROM gm GROUP BY 1, 2)",
    )
    + "SELECT vec_id, ROUND(-regr_slope(LOG10(ap), LOG10(k)), 6) + 0.0 AS exponent, ROUND(regr_intercept(LOG10(ap), LOG10(k)), 6) + 0.0 AS intercept FROM ap WHERE k BETWEEN 1 AND 30 GROUP BY 1"
)
def irasa_lite(spark, d):
    """1/f line through the aperiodic part found by irregular resampling of the spectrum."""
    aper = spectra(spark, d).select("vec_id", sp.irasa_lite(F.col("p"), HSET).alias("a"))
    fit = aper.select("vec_id", sp.log_fit(F.col("a"), STEP, 1.0, 30.0).alias("f"))
    return fit.select("vec_id", rnd(-F.col("f.slope")).alias("exponent"), rnd(F.col("f.intercept") / F.ln(F.lit(10.0))).alias("intercept"))


CODES = """trip AS (SELECT vec_id, x AS a, LEAD(x) OVER w AS b, LEAD(x, 2) OVER w AS c FROM sig WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
codes AS (SELECT vec_id, CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= b AND a <= c THEN 1 WHEN a <= b THEN 2 WHEN a <= c THEN 3 WHEN b <= c THEN 4 ELSE 5 END AS code FROM trip WHERE c IS NOT NULL),
cnt AS (SELECT vec_id, code, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY vec_id) AS m FROM codes GROUP BY 1, 2)"""


@query(with_(SIG, CODES) + "SELECT vec_id, ROUND(SUM(-n / m * LN(n / m)) / LN(6), 6) + 0.0 AS pe FROM cnt GROUP BY 1")
def perm_entropy(spark, d):
    """Permutation entropy of order 3."""
    return epochs(spark, d).select("vec_id", rnd(nl.permutation_entropy(F.col("x"))).alias("pe"))


@query(with_(SIG, CODES) + "SELECT vec_id, ROUND(CASE WHEN COUNT(*) > 1 THEN COUNT(*) * LN(COUNT(*)) / 64 ELSE 0 END, 6) + 0.0 AS plzc FROM cnt GROUP BY 1")
def plzc(spark, d):
    """Complexity by the number of ordinal patterns."""
    return epochs(spark, d).select("vec_id", rnd(nl.pattern_complexity(F.col("x"))).alias("plzc"))


@query(
    "WITH "
    + SIG.replace("sig AS", "raw AS")
    + ", cg AS (SELECT vec_id, s, i // s AS i, AVG(x) AS x, COUNT(*) AS n FROM raw, (SELECT UNNEST([1, 2, 3]) AS s) GROUP BY 1, 2, 3), "
    + "sig AS (SELECT vec_id * 10 + s AS vec_id, i, x, s FROM cg WHERE n = s), "
    + CODES
    + """, ln AS (SELECT vec_id, COUNT(*) AS len FROM sig GROUP BY 1)
SELECT vec_id // 10 AS vec_id, (vec_id % 10)::INT AS scale, ROUND(CASE WHEN COUNT(*) > 1 THEN COUNT(*) * LN(COUNT(*)) / MAX(len) ELSE 0 END, 6) + 0.0 AS plzc FROM cnt JOIN ln USING (vec_id) GROUP BY vec_id"""
)
def multiscale_plzc(spark, d):
    """Complexity by ordinal patterns at scales 1, 2 and 3."""
    scales = F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), nl.coarse(F.col("x"), s).alias("y")) for s in (1, 2, 3))))
    rows = epochs(spark, d).select("vec_id", scales.alias("s"))
    return rows.select("vec_id", "s.scale", rnd(nl.pattern_complexity(F.col("s.y"))).alias("plzc"))


@query(
    with_(SIG, CODES.split(",\ncodes")[0])
    + """, g AS (SELECT vec_id, SUM(a*a) AS aa, SUM(b*b) AS bb, SUM(c*c) AS cc, SUM(a*b) AS ab, SUM(b*c) AS bc, SUM(a*c) AS ac FROM trip WHERE c IS NOT NULL GROUP BY 1),
t AS (SELECT *, (aa + bb + cc) / 3 AS t FROM g),
s AS (SELECT *, SQRT((POWER(aa - t, 2) + POWER(bb - t, 2) + POWER(cc - t, 2) + 2 * (ab * ab + bc * bc + ac * ac)) / 6) AS s FROM t),
r AS (SELECT vec_id, t, s, ACOS(GREATEST(-1, LEAST(1, ((aa - t) * ((bb - t) * (cc - t) - bc * bc) - ab * (ab * (cc - t) - bc * ac) + ac * (ab * bc - (bb - t) * ac)) / (2 * POWER(s, 3))))) / 3 AS phi FROM s),
v AS (SELECT vec_id, SQRT(GREATEST(0, t + 2 * s * COS(phi + 2 * PI() * j / 3))) AS sv FROM r, (SELECT UNNEST([0, 1, 2]) AS j)),
w AS (SELECT vec_id, sv / SUM(sv) OVER (PARTITION BY vec_id) AS p FROM v)
SELECT vec_id, ROUND(SUM(-p * LOG2(p)) / LOG2(3), 6) + 0.0 AS svd FROM w GROUP BY 1"""
)
def svd_entropy(spark, d):
    """Entropy of the singular values of the three-sample embedding."""
    return epochs(spark, d).select("vec_id", rnd(nl.svd_entropy(F.col("x"))).alias("svd"))


DIFFS = "df AS (SELECT vec_id, i, x, x - LAG(x) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM sig)"


@query(
    with_(SIG, DIFFS)
    + """SELECT vec_id, ROUND(LOG10(64) / (LOG10(64) + LOG10(64 / (64 + 0.4 * SUM((d * e < 0)::INT)))), 6) + 0.0 AS fd
FROM (SELECT vec_id, d, LEAD(d) OVER (PARTITION BY vec_id ORDER BY i) AS e FROM df) GROUP BY 1"""
)
def petrosian_fd(spark, d):
    return epochs(spark, d).select("vec_id", rnd(nl.petrosian_fd(F.col("x"))).alias("fd"))


@query(
    with_(SIG, DIFFS)
    + """SELECT vec_id, ROUND(LOG10(SUM(ABS(d)) / AVG(ABS(d))) / LOG10(MAX(ABS(x - x0)) / AVG(ABS(d))), 6) + 0.0 AS fd
FROM (SELECT *, FIRST_VALUE(x) OVER (PARTITION BY vec_id ORDER BY i) AS x0 FROM df) GROUP BY 1"""
)
def katz_fd(spark, d):
    return epochs(spark, d).select("vec_id", rnd(nl.katz_fd(F.col("x"))).alias("fd"))


@query(
    with_(SIG)
    + """, km AS (SELECT k, m, (64 - m - 1) // k AS nm FROM (SELECT UNNEST(range(1, 11)) AS k), (SELECT UNNEST(range(0, 10)) AS m) WHERE m < k),
l AS (SELECT a.vec_id, k, m, SUM(ABS(b.x - a.x)) / k * 63 / (k * ANY_VALUE(nm)) AS l FROM sig a, km, sig b
  WHERE a.vec_id = b.vec_id AND a.i % k = m AND b.i = a.i + k AND (a.i - m) // k < nm - 1 GROUP BY 1, 2, 3)
SELECT vec_id, ROUND(regr_slope(LN(l), LN(1.0 / k)), 6) + 0.0 AS fd FROM (SELECT vec_id, k, AVG(l) AS l FROM l GROUP BY 1, 2) GROUP BY 1"""
)
def higuchi_fd(spark, d):
    """Higuchi dimension with ten lags."""
    return epochs(spark, d).select("vec_id", rnd(nl.higuchi_fd(F.col("x"))).alias("fd"))


@query(
    with_(SIG)
    + """, c AS (SELECT vec_id, i, x - AVG(x) OVER (PARTITION BY vec_id) AS x FROM sig),
r AS (SELECT a.vec_id, b.i - a.i AS lag, SUM(a.x * b.x) AS s FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.i >= a.i GROUP BY 1, 2)
SELECT vec_id, ROUND(COALESCE(MIN(lag) FILTER (lag > 0 AND s / z <= 0.5), 64) / 64, 6) + 0.0 AS acw FROM (SELECT *, MAX(s) FILTER (lag = 0) OVER (PARTITION BY vec_id) AS z FROM r) GROUP BY 1"""
)
def acw(spark, d):
    """Autocorrelation window in seconds."""
    return epochs(spark, d).select("vec_id", rnd(nl.acw(F.col("x"), SRATE)).alias("acw"))


@query(
    with_(SIG, DIFFS, "d2 AS (SELECT vec_id, x, d, d - LAG(d) OVER (PARTITION BY vec_id ORDER BY i) AS e FROM df)")
    + """SELECT vec_id, ROUND(VAR_POP(x), 6) + 0.0 AS activity, ROUND(SQRT(VAR_POP(d) / VAR_POP(x)), 6) + 0.0 AS mobility,
ROUND(SQRT(VAR_POP(e) / VAR_POP(d)) / SQRT(VAR_POP(d) / VAR_POP(x)), 6) + 0.0 AS complexity FROM d2 GROUP BY 1"""
)
def hjorth(spark, d):
    """Activity, mobility and complexity."""
    h = epochs(spark, d).select("vec_id", nl.hjorth(F.col("x")).alias("h"))
    return h.select("vec_id", *(rnd(F.col(f"h.{k}")).alias(k) for k in ("activity", "mobility", "complexity")))


@query(with_(SIG) + "SELECT vec_id, ROUND(SQRT(AVG(x * x)), 6) + 0.0 AS rms, ROUND(VAR_POP(x), 6) + 0.0 AS var FROM sig GROUP BY 1")
def rms_variance(spark, d):
    power = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x")
    return epochs(spark, d).select("vec_id", rnd(F.sqrt(power)).alias("rms"), rnd(variance(F.col("x"))).alias("var"))


@query(with_(SIG) + "SELECT vec_id, (i // 16)::INT AS sub, ROUND(AVG(x), 6) + 0.0 AS mean FROM sig GROUP BY 1, 2")
def sub_epoch(spark, d):
    """Means of quarter epochs."""
    parts = segment.sub_epochs(epochs(spark, d).select("vec_id", "x"), 16)
    return parts.select("vec_id", "sub", rnd(let(F.col("x"), lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))).alias("mean"))


@query(
    with_(SIG)
    + "SELECT vec_id, w::INT AS window, ROUND(MAX(x) - MIN(x), 6) + 0.0 AS range FROM sig, (SELECT UNNEST(range(0, 7)) AS w) WHERE i >= 8 * w AND i < 8 * w + 16 GROUP BY 1, 2"
)
def sliding_epoch(spark, d):
    """Range of values in windows of 16 samples every 8."""
    parts = segment.sliding_epochs(epochs(spark, d).select("vec_id", "x"), 16, 8)
    return parts.select("vec_id", "window", rnd(F.array_max("x") - F.array_min("x")).alias("range"))


@query(with_(SIG) + "SELECT vec_id, i // 4 AS i, ROUND(AVG(x), 6) + 0.0 AS x FROM sig GROUP BY 1, 2")
def coarse_grain(spark, d):
    out = segment.coarse_grain(samples(spark, d).select("vec_id", "i", "x"), ["vec_id"], 4)
    return out.select("vec_id", "i", rnd(F.col("x")).alias("x"))


@query(with_(SIG) + "SELECT vec_id, i * 2 + r AS i, ROUND(x, 6) + 0.0 AS x FROM sig, (SELECT UNNEST([0, 1]) AS r)")
def sample_hold_upsample(spark, d):
    """Every sample twice."""
    out = segment.sample_hold(samples(spark, d).select("vec_id", F.col("i").cast("long").alias("i"), "x"), 2)
    return out.select("vec_id", "i", rnd(F.col("x")).alias("x"))


@query(with_(SIG) + "SELECT label, i, ROUND(AVG(x), 6) + 0.0 AS erp, COUNT(*) AS trials FROM sig GROUP BY 1, 2")
def erp_average(spark, d):
    """Mean over the epochs of each class at each sample."""
    s = samples(spark, d).groupBy("label", F.col("i").cast("long").alias("i"))
    return s.agg(rnd(F.avg("x")).alias("erp"), F.count("*").alias("trials"))


@query(
    with_(SIG)
    + "SELECT vec_id, i, ROUND(x - SUM(x) OVER (PARTITION BY i) / (COUNT(*) OVER (PARTITION BY i) + 1), 6) + 0.0 AS x FROM sig"
)
def common_average_ref(spark, d):
    """Every channel less the average that keeps the rank: the sum over the number of channels plus one."""
    s = samples(spark, d).select("vec_id", F.col("i").cast("long").alias("i"), "x")
    s = series.with_stats(s, ["i"], ref=F.sum("x") / (F.count("*") + 1))
    return s.select("vec_id", "i", rnd(F.col("x") - F.col("ref")).alias("x"))


@query(
    with_(SIG, "lv AS (SELECT vec_id, i, x, (x + COALESCE(LAG(x) OVER w, x)) / 2 AS a1 FROM sig WINDOW w AS (PARTITION BY vec_id ORDER BY i))")
    + ", l2 AS (SELECT *, (a1 + COALESCE(LAG(a1, 2) OVER w, FIRST_VALUE(a1) OVER w)) / 2 AS a2 FROM lv WINDOW w AS (PARTITION BY vec_id ORDER BY i)) "
    + "SELECT vec_id, i, ROUND(x - a1, 6) + 0.0 AS d1, ROUND(a1 - a2, 6) + 0.0 AS d2, ROUND(a2, 6) + 0.0 AS a2 FROM l2"
)
def haar_mra(spark, d):
    """Two levels of the undecimated Haar transform; details and the rest add up to the signal."""
    from signalspark.operators.cleaning import haar_levels

    out = haar_levels(samples(spark, d).select("vec_id", F.col("i").cast("long").alias("i"), "x"), ["vec_id"], 2)
    return out.select("vec_id", "i", *(rnd(F.col(c)).alias(c) for c in ("d1", "d2", "a2")))


@query(with_(SIG) + "SELECT vec_id, ROUND(kurtosis_pop(x), 6) + 0.0 AS kurtosis, ROUND(SUM(POWER(x - m, 3)) / 64 / POWER(VAR_POP(x), 1.5), 6) + 0.0 AS skewness FROM (SELECT *, AVG(x) OVER (PARTITION BY vec_id) AS m FROM sig) GROUP BY 1")
def moments(spark, d):
    """Third and fourth standardised moments."""

    def m(c, k):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(float(k)))) / F.size(c)

    c = epochs(spark, d).select("vec_id", let(center(F.col("x")), lambda c: F.struct(m(c, 2).alias("m2"), m(c, 3).alias("m3"), m(c, 4).alias("m4"))).alias("m"))
    return c.select("vec_id", rnd(F.expr("m.m4 / (m.m2 * m.m2)") - 3).alias("kurtosis"), rnd(F.expr("m.m3 / power(m.m2, 1.5)")).alias("skewness"))
