"""Queries on recordings with gaps, annotations, windows, and measures that build on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalspark.functions import kernels as k
from signalspark.functions.arrays import rnd
from signalspark.operators import cardiac, connectivity, graph, segment, series, stats, timeline
from signalspark.plans.catalog_graph import BLOCKS, GRAPH, TRIPLES, _channels, _graph, _hourly, _triples
from signalspark.plans.catalog_series import DZ, EXT
from signalspark.plans.cleaning import clean, run_log
from signalspark.plans.inputs import EVT, SIG, SRATE, SUP, daily_series, epochs, event_series, samples, supplier_series, table, with_
from signalspark.plans.registry import query

# --- sequences with gaps: 40 samples at 1 Hz, then 10 seconds without --------------------------------------------
SEQ = """sp AS (SELECT chan, i // 40 AS seq, i % 40 AS k, x FROM sup),
sq AS (SELECT chan, seq, seq * 50.0::DOUBLE + (chan % 4) * 0.25::DOUBLE AS start, COUNT(*) AS n FROM sp GROUP BY 1, 2),
sf AS (SELECT *, (SUM(n) OVER (PARTITION BY chan ORDER BY seq) - n)::BIGINT AS first, start + n AS stop FROM sq)"""
TIMES = "tm AS (SELECT DISTINCT o_custkey % 40 + 1 AS chan, (o_orderkey % 6000) * 0.5::DOUBLE AS t FROM orders)"


def _sequences(spark, d):
    """Samples (chan, seq, k, x) and sequences (chan, seq, start, n) of the suppliers' prices."""
    s = supplier_series(spark, d).select("chan", F.floor(F.col("i") / 40).alias("seq"), (F.col("i") % 40).alias("k"), "x")
    starts = s.where("k = 0").select("chan", "seq", (F.col("seq") * 50.0 + F.pmod("chan", F.lit(4)) * 0.25).alias("start"))
    return s, timeline.sequences(s, starts, ["chan"])


def _times(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 40 + 1).alias("chan"), ((F.col("o_orderkey") % 6000) * 0.5).alias("t")).distinct()


@query(with_(SUP, SEQ) + "SELECT chan, seq, start, n, first, n::DOUBLE AS duration, stop FROM sf")
def sequence_table(spark, d):
    """Uninterrupted stretches with their place, start and duration."""
    return timeline.numbered(_sequences(spark, d)[1], ["chan"], 1.0).select("chan", "seq", "start", "n", "first", "duration", "stop")


@query(with_(SUP, SEQ) + "SELECT sp.chan, sp.seq, k, first + k AS index, start + k AS t FROM sp JOIN sf USING (chan, seq)")
def sample_times(spark, d):
    """Local and global numbers of samples and their times."""
    s, q = _sequences(spark, d)
    return timeline.sample_times(s, q, ["chan"], 1.0).select("chan", "seq", "k", "index", "t")


@query(
    with_(SUP, SEQ, TIMES)
    + """SELECT tm.chan, tm.t, CASE WHEN FLOOR(tm.t - start) < n THEN seq END AS seq, CASE WHEN FLOOR(tm.t - start) < n THEN FLOOR(tm.t - start)::BIGINT END AS k,
CASE WHEN FLOOR(tm.t - start) < n THEN first + FLOOR(tm.t - start)::BIGINT END AS index FROM tm ASOF LEFT JOIN sf ON tm.chan = sf.chan AND tm.t >= sf.start"""
)
def locate_times(spark, d):
    """Sequence, local and global number of the sample that holds at a time."""
    return timeline.locate(_times(spark, d), _sequences(spark, d)[1], ["chan"], 1.0).select("chan", "t", "seq", "k", "index")


@query(
    with_(SUP, SEQ, "pl AS (SELECT DISTINCT o_custkey % 40 + 1 AS chan, o_orderkey % 700 AS index FROM orders)")
    + "SELECT pl.chan, pl.index, CASE WHEN pl.index - first < n THEN seq END AS seq, CASE WHEN pl.index - first < n THEN start + pl.index - first END AS t FROM pl ASOF LEFT JOIN sf ON pl.chan = sf.chan AND pl.index >= sf.first"
)
def times_of_places(spark, d):
    """Times of global numbers of samples."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40 + 1).alias("chan"), (F.col("o_orderkey") % 700).cast("long").alias("index")).distinct()
    return timeline.times_of(o, _sequences(spark, d)[1], ["chan"], 1.0).select("chan", "index", "seq", "t")


@query(
    with_(SUP, SEQ, TIMES)
    + """, lo AS (SELECT tm.chan, tm.t, seq, FLOOR(tm.t - start)::BIGINT AS k FROM tm ASOF LEFT JOIN sf ON tm.chan = sf.chan AND tm.t >= sf.start)
SELECT lo.chan, lo.t, ROUND(COALESCE(x, -1), 6) + 0.0 AS x FROM lo LEFT JOIN sp USING (chan, seq, k)"""
)
def random_access(spark, d):
    """Single samples by time, a default in gaps."""
    s, q = _sequences(spark, d)
    return timeline.values_at(_times(spark, d), s, q, ["chan"], 1.0, -1.0).select("chan", "t", rnd(F.col("x")).alias("x"))


@query(
    with_(SUP, SEQ)
    + """, en AS (SELECT chan, MIN(start) AS a, LEAST(330.5, MAX(stop)) AS b FROM sf GROUP BY 1),
gr AS (SELECT chan, UNNEST(range(GREATEST(0, CEIL(a - 20.5))::BIGINT, CEIL(b - 20.5)::BIGINT)) AS g FROM en),
hd AS (SELECT sp.chan, CEIL(start - 20.5)::BIGINT + k AS g, x FROM sp JOIN sf USING (chan, seq)),
v AS (SELECT gr.chan, gr.g, COALESCE(x, 0) AS x FROM gr LEFT JOIN hd USING (chan, g))
SELECT chan, g * 3 + c AS i, ROUND(20.5 + (g * 3 + c) / 3, 6) AS t, ROUND(x, 6) + 0.0 AS x FROM v, (SELECT UNNEST(range(0, 3)) AS c)"""
)
def range_scan(spark, d):
    """Samples of 20.5 to 330.5 s, zeros in gaps, each three times."""
    s, q = _sequences(spark, d)
    out = timeline.range_scan(s, q, ["chan"], 1.0, 20.5, 330.5, 0.0, 3)
    return out.select("chan", "i", rnd(F.col("t")).alias("t"), rnd(F.col("x")).alias("x"))


@query(with_(SUP) + "SELECT chan, i, ROUND(x, 6) + 0.0 AS x FROM (SELECT *, (MIN(i) OVER w + MAX(i) OVER w) / 2 AS m FROM sup WINDOW w AS (PARTITION BY chan)) WHERE i >= m - 12.5 AND i < m + 12.5")
def snapshot_crop(spark, d):
    """25 seconds around the middle of each recording."""
    return timeline.crop_centred(supplier_series(spark, d), ["chan"], 25.0, "i").select("chan", F.col("i").cast("long").alias("i"), rnd(F.col("x")).alias("x"))


# --- annotations and text fields ------------------------------------------------------------------------------------
CODES = {"view": 1, "click": 2, "purchase": 3, "signup": 4}


@query(
    """SELECT event_id, ROUND(event_id / 250.0, 6) + 0.0 AS onset, 0.0::DOUBLE AS duration, CASE code WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'purchase' WHEN 4 THEN 'signup' ELSE code::VARCHAR END AS description
FROM (SELECT event_id, event_id % 6 AS code FROM events)"""
)
def event_annotations(spark, d):
    """An event matrix of samples and codes as onsets with names."""
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("sample"), (F.col("event_id") % 6).cast("int").alias("code"))
    out = timeline.annotations(e, CODES, 250.0)
    return out.select("event_id", rnd(F.col("onset")).alias("onset"), "duration", "description")


@query(with_(SIG) + "SELECT vec_id, i / 64 AS onset, 0.0::DOUBLE AS duration, FLOOR(x * 40)::INT::VARCHAR AS description FROM sig WHERE FLOOR(x * 40) > 0")
def marker_annotations(spark, d):
    """Positive markers of each epoch as annotations."""
    e = epochs(spark, d).select("vec_id", F.transform("x", lambda v: F.floor(v * 40).cast("int")).alias("markers"))
    return timeline.marker_annotations(e, "markers", SRATE)


@query(with_(EVT) + "SELECT event_id, strftime(make_timestamp((FLOOR(t) * 1000000)::BIGINT), '%d.%m.%y') AS day, strftime(make_timestamp((FLOOR(t) * 1000000)::BIGINT), '%H.%M.%S') AS clock FROM evt")
def header_stamps(spark, d):
    """Dates and times as a recording's header has them."""
    day, clock = timeline.stamp_parts("t")
    return event_series(spark, d).select("event_id", day.alias("day"), clock.alias("clock"))


@query("SELECT c_custkey, CASE WHEN s = '' THEN 'none' ELSE replace(s, 'I', '_') END AS field FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS s FROM customer)")
def replace_in_field(spark, d):
    """A text field with a stand-in where it is empty."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("s"))
    return c.select("c_custkey", timeline.replaced_or("s", "none", "I", "_").alias("field"))


@query(
    """WITH p AS (SELECT doc_id, UNNEST(string_split(text, 'the')) AS part, generate_subscripts(string_split(text, 'the'), 1) - 1 AS n, len(string_split(text, 'the')) AS m FROM documents)
SELECT doc_id, n, place FROM (SELECT doc_id, n, m, (SUM(LENGTH(part)) OVER (PARTITION BY doc_id ORDER BY n) + n * 3)::BIGINT AS place FROM p) WHERE n < m - 1"""
)
def token_offsets(spark, d):
    """Where a token occurs in texts."""
    out = timeline.token_offsets(table(spark, d, "documents"), ["doc_id"], "text", "the")
    return out.select("doc_id", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


@query("SELECT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0 INTERSECT SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 1000")
def common_names(spark, d):
    """Names that stand in both of two lists."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    c = table(spark, d, "customer").where("c_acctbal < 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("name")
    s = table(spark, d, "supplier").where("s_acctbal < 1000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("name")
    return c.intersect(s)


# --- windows and epochs -------------------------------------------------------------------------------------------
WINDOWS = """hr AS (SELECT user_id % 10 AS g, chan, FLOOR(t / 3600)::BIGINT AS h, AVG(x) AS x FROM evt GROUP BY 1, 2, 3),
hw AS (SELECT g, chan, h, x, UNNEST(range(GREATEST(0, (FLOOR((h - h0 - 96) / 48.0) + 1)::BIGINT), (h - h0) // 48 + 1)) AS window FROM (SELECT *, h - h0 AS at FROM hr, (SELECT MIN(h) AS h0 FROM hr)))"""


def _windows(spark, d):
    """Hourly means in windows of 96 hours, every 48."""
    h = _hourly(spark, d)
    first = h.agg(F.min("h").alias("h0"))  # one row
    h = h.join(F.broadcast(first)).withColumn("at", F.col("h") - F.col("h0"))
    return segment.sliding_windows(h, 96, 48, "at")


@query(with_(EVT, WINDOWS) + "SELECT a.g, a.window, a.chan AS a, b.chan AS b, COUNT(*) AS n, ROUND(corr(a.x, b.x), 6) + 0.0 AS r FROM hw a JOIN hw b ON a.g = b.g AND a.window = b.window AND a.h = b.h AND a.chan < b.chan GROUP BY 1, 2, 3, 4")
def window_connectivity(spark, d):
    """Correlations of two types within sliding windows."""
    c = connectivity.correlation(_windows(spark, d), ["g", "window"], "chan", "h")
    return c.select("g", "window", "a", "b", "n", rnd(F.col("r")).alias("r"))


def _poly(factors, x):
    out = f"({factors[0]!r})::DOUBLE"
    for f in factors[1:]:
        out = f"({out} * {x} + ({f!r})::DOUBLE)"
    return out


def _quantile_sql(p: str) -> str:
    low, high = f"SQRT(-2 * LN({p}))", f"SQRT(-2 * LN(1 - {p}))"
    tail = lambda q: f"{_poly(stats.QUANTILE_C, q)} / {_poly(stats.QUANTILE_D, q)}"
    middle = f"({p} - 0.5) * {_poly(stats.QUANTILE_A, f'POWER({p} - 0.5, 2)')} / {_poly(stats.QUANTILE_B, f'POWER({p} - 0.5, 2)')}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -({tail(high)}) ELSE {middle} END"


@query(
    with_(EVT, WINDOWS)
    + f""", rk AS (SELECT g, "window", chan, h, (RANK() OVER (PARTITION BY g, "window", chan ORDER BY x) - 0.5) / COUNT(x) OVER (PARTITION BY g, "window", chan) AS p FROM hw),
sc AS (SELECT g, "window", chan, h, {_quantile_sql('p')} AS x FROM rk),
rr AS (SELECT a.g, a.window, a.chan AS a, b.chan AS b, COUNT(*) AS n, corr(a.x, b.x) AS r FROM sc a JOIN sc b ON a.g = b.g AND a.window = b.window AND a.h = b.h AND a.chan < b.chan GROUP BY 1, 2, 3, 4)
SELECT g, "window", a, b, n, CASE WHEN 1 - r * r > 1e-12 THEN ROUND(-0.5 * LOG2(1 - r * r), 6) + 0.0 END AS mi FROM rr"""
)
def copula_mi(spark, d):
    """Gaussian-copula information of two types within sliding windows."""
    c = connectivity.copula_mi(_windows(spark, d), ["g", "window"], "chan", "h")
    return c.select("g", "window", "a", "b", "n", rnd(F.col("mi")).alias("mi"))


@query(with_(EVT, "rk AS (SELECT event_id, (RANK() OVER (PARTITION BY chan ORDER BY x) - 0.5) / COUNT(x) OVER (PARTITION BY chan) AS p FROM evt)") + f"SELECT event_id, ROUND({_quantile_sql('p')}, 6) + 0.0 AS z FROM rk")
def quantile_normal(spark, d):
    """Values as normal quantiles of their rank within their type."""
    q = stats.quantile_rank(event_series(spark, d), ["chan"], "x")
    return q.select("event_id", rnd(stats.normal_quantile(F.col("q"))).alias("z"))


@query(
    with_(SUP)
    + """, c AS (SELECT chan, i, x, COUNT(*) OVER (PARTITION BY chan) // 20 * 20 AS m FROM sup),
a AS (SELECT chan, i, x, i // 20 AS e, CASE WHEN i >= 10 AND i < m - 10 THEN 0.5 - 0.5 * COS(2 * PI() * (i % 20 + 1) / 20) ELSE 1 END AS w, 0 AS s FROM c WHERE i < m
UNION ALL SELECT chan, i, x, (i - 10) // 20, 0.5 - 0.5 * COS(2 * PI() * ((i - 10) % 20 + 1) / 20), 1 FROM c WHERE i >= 10 AND i < m - 10)
SELECT chan, i, ROUND(SUM((x - mean) * w), 6) + 0.0 AS x FROM (SELECT *, AVG(x) OVER (PARTITION BY chan, s, e) AS mean FROM a) GROUP BY 1, 2"""
)
def overlap_add(spark, d):
    """Epochs of 20 samples in two half-shifted streams, each without its mean, put together by raised cosines."""
    rows = segment.half_shift_epochs(supplier_series(spark, d), ["chan"], 20)
    rows = series.with_stats(rows, ["chan", "stream", "epoch"], mean=F.avg("x")).withColumn("x", F.col("x") - F.col("mean"))
    return segment.overlap_add(rows, ["chan"]).select("chan", F.col("i").cast("long").alias("i"), rnd(F.col("x")).alias("x"))


@query(with_(SUP) + "SELECT chan, i, ROUND(SUM(x) OVER (PARTITION BY chan ORDER BY i ROWS 19 PRECEDING) / 20, 4) + 0.0 AS y FROM sup")
def average_filter(spark, d):
    """Moving average over 20 samples, zeros before the first."""
    out = series.trailing_mean(supplier_series(spark, d), ["chan"], 20)
    return out.select("chan", F.col("i").cast("long").alias("i"), rnd(F.col("y"), 4).alias("y"))


# --- spectra ------------------------------------------------------------------------------------------------------
SEGMENTS = """sg AS (SELECT vec_id, s, i - 16 * s AS u, x FROM sig, (SELECT UNNEST(range(0, 3)) AS s) WHERE i >= 16 * s AND i < 16 * s + 32),
sc AS (SELECT vec_id, s, u, (x - AVG(x) OVER (PARTITION BY vec_id, s)) * (0.54 - 0.46 * COS(2 * PI() * u / 32)) AS x FROM sg),
ft AS (SELECT vec_id, s, k, SUM(x * COS(2 * PI() * ((k * u) % 32) / 32)) AS re, SUM(x * SIN(2 * PI() * ((k * u) % 32) / 32)) AS im FROM sc, (SELECT UNNEST(range(0, 17)) AS k) GROUP BY 1, 2, 3),
ww AS (SELECT SUM(POWER(0.54 - 0.46 * COS(2 * PI() * j / 32), 2)) AS w FROM (SELECT UNNEST(range(0, 32)) AS j)),
wp AS (SELECT vec_id, k, MEDIAN((re * re + im * im) * CASE WHEN k = 0 OR k = 16 THEN 1 ELSE 2 END / (64 * w)) / (1 + 1 / 3 - 1 / 2) AS p FROM ft, ww GROUP BY 1, 2)"""


def _spectrum(df):
    return df.select("vec_id", F.posexplode("p").alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), rnd(F.col("p")).alias("p"))


@query(with_(SIG, SEGMENTS) + "SELECT vec_id, k, ROUND(p, 6) + 0.0 AS p FROM wp")
def welch_segments(spark, d):
    """Welch spectra of three half-overlapping segments of 32 samples, their median without its bias."""
    return _spectrum(k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"p": k.welch(x, SRATE, 32)[1]}, "p array<double>"))


TAPERS = """ct AS (SELECT vec_id, i, x - AVG(x) OVER (PARTITION BY vec_id) AS x FROM sig),
tp AS (SELECT vec_id, h, i, x * SQRT(2.0 / 65) * SIN(h * (i + 1) * PI() / 65) AS x FROM ct, (SELECT UNNEST(range(1, 6)) AS h)),
tf AS (SELECT vec_id, h, k, SUM(x * COS(2 * PI() * ((k * i) % 64) / 64)) AS re, SUM(x * SIN(2 * PI() * ((k * i) % 64) / 64)) AS im FROM tp, (SELECT UNNEST(range(0, 33)) AS k) GROUP BY 1, 2, 3),
mt AS (SELECT vec_id, k, AVG(re * re + im * im) / 64 * CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END AS p FROM tf GROUP BY 1, 2)"""


@query(with_(SIG, TAPERS) + "SELECT vec_id, k, ROUND(p, 6) + 0.0 AS p FROM mt")
def multitaper_psd(spark, d):
    """Mean spectra over five sine tapers."""
    return _spectrum(k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"p": k.multitaper(x, SRATE)[1]}, "p array<double>"))


@query(with_(SIG, SEGMENTS, TAPERS) + "SELECT vec_id, k, ROUND(p, 6) + 0.0 AS p FROM (SELECT vec_id, 2 * k AS k, p FROM wp WHERE k <= 6 UNION ALL SELECT vec_id, k, p FROM mt WHERE k > 12)")
def hybrid_psd(spark, d):
    """Welch spectra up to 12 Hz, tapered ones above."""

    def kernel(x):
        low, high = k.welch(x, SRATE, 32), k.multitaper(x, SRATE)
        return {"low": low[1][:, low[0] <= 12], "high": high[1][:, high[0] > 12]}

    out = k.map_epochs(epochs(spark, d), ["vec_id"], kernel, "low array<double>, high array<double>")
    low = out.select("vec_id", F.posexplode("low").alias("k", "p")).select("vec_id", F.col("k") * 2, "p").toDF("vec_id", "k", "p")
    high = out.select("vec_id", F.posexplode("high").alias("k", "p")).select("vec_id", F.col("k") + 13, "p").toDF("vec_id", "k", "p")
    both = low.unionByName(high)
    return both.select("vec_id", F.col("k").cast("long").alias("k"), rnd(F.col("p")).alias("p"))


# --- statistics and graphs ------------------------------------------------------------------------------------------
T_VALUE = """tv AS (SELECT id, n - 3 AS nu, (xy - xz) * SQRT((n - 1) * (1 + yz) / (2 * (n - 1) / (n - 3) * (1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz) + POWER((xy + xz) / 2, 2) * POWER(1 - yz, 3))) AS t
FROM tp WHERE 1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz > 0)"""


@query(
    with_(TRIPLES, T_VALUE)
    + """, an AS (SELECT id, nu, nu % 2 AS odd, ABS(t) / SQRT(nu + t * t) AS s, SQRT(nu / (nu + t * t)) AS c, ATAN(ABS(t) / SQRT(nu)) AS angle FROM tv),
tr AS (SELECT id, j, odd, c, SUM(CASE WHEN j = 0 THEN 0 ELSE LN((2 * j - 1 + odd) / (2 * j + odd)) END) OVER (PARTITION BY id ORDER BY j) AS l FROM (SELECT *, UNNEST(range(0, (nu - 2 - odd) // 2 + 1)) AS j FROM an)),
sm AS (SELECT id, SUM(EXP(l) * POWER(c, 2 * j + odd)) AS q FROM tr GROUP BY 1)
SELECT id, ROUND(GREATEST(0, 1 - CASE WHEN odd = 0 THEN s * q ELSE 2 / PI() * (angle + s * q) END), 6) + 0.0 AS p FROM an JOIN sm USING (id)"""
)
def dependent_p(spark, d):
    """Two-sided p of the difference of two correlations that share a variable."""
    xy, xz, yz, n = (F.col(c) for c in ("xy", "xz", "yz", "n"))
    ok = 1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz > 0
    t = _triples(spark, d).where(ok).withColumn("t", stats.steiger_t(xy, xz, yz, n))
    return t.select("id", rnd(stats.student_two_sided(F.col("t"), n - 3)).alias("p"))


@query(
    with_(TRIPLES)
    + """, z AS (SELECT id, ABS(ATANH(xy) - ATANH(xz)) / SQRT(1.0 / (n - 3) + 1.0 / (n + 7)) / SQRT(2) AS x FROM tp), t AS (SELECT id, x, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM z)
SELECT id, ROUND(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * EXP(-x * x), 6) + 0.0 AS p FROM t"""
)
def independent_p(spark, d):
    """Two-sided p of the difference of two independent correlations."""
    z = stats.fisher_z(F.col("xy"), F.col("xz"), F.col("n"), F.col("n") + 10)
    return _triples(spark, d).select("id", rnd(stats.normal_two_sided(z)).alias("p"))


def _paths_sql(graph_name: str, name: str) -> str:
    return f"""{name}p(g, a, b, d) AS (SELECT g, a, b, 1 FROM {graph_name} UNION SELECT p.g, p.a, e.b, p.d + 1 FROM {name}p p JOIN {graph_name} e ON e.g = p.g AND e.a = p.b WHERE p.d < 40),
{name} AS (SELECT g, a, b, MIN(d) AS d FROM {name}p WHERE a <> b GROUP BY 1, 2, 3)"""


def _world_sql(edges: str, paths: str, name: str) -> str:
    return f"""{name}k AS (SELECT g, a AS node, COUNT(*) AS k FROM {edges} GROUP BY 1, 2),
{name}t AS (SELECT x.g, x.a AS node, COUNT(*) / 2 AS t FROM {edges} x JOIN {edges} y ON x.g = y.g AND x.b = y.a JOIN {edges} z ON y.g = z.g AND y.b = z.a AND z.b = x.a GROUP BY 1, 2),
{name}c AS (SELECT nd.g, AVG(CASE WHEN COALESCE(k, 0) < 2 THEN 0 ELSE 2.0 * COALESCE(t, 0) / (k * (k - 1)) END) AS c FROM nd LEFT JOIN {name}k USING (g, node) LEFT JOIN {name}t USING (g, node) GROUP BY 1),
{name} AS (SELECT nn.g, CASE WHEN COUNT(d) = MAX(n) * (MAX(n) - 1) THEN AVG(d) END AS l, ANY_VALUE(c) AS c FROM nn LEFT JOIN {paths} USING (g) LEFT JOIN {name}c USING (g) GROUP BY 1)"""


HALF_GRAPH = GRAPH.replace("quantile_cont(w, 0.9)", "quantile_cont(w, 0.75)")


@query(
    "WITH RECURSIVE "
    + HALF_GRAPH
    + """, sh0 AS (SELECT ge.g, 2.0 * COUNT(*) / (MAX(n) * (MAX(n) - 1)) AS share FROM ge JOIN nn USING (g) GROUP BY 1),
rg AS (SELECT x.g, x.node AS a, y.node AS b FROM nd x JOIN nd y ON x.g = y.g AND x.node < y.node JOIN sh0 ON sh0.g = x.g WHERE ('0x' || md5('0:' || x.g || ':' || x.node || ':' || y.node)[1:8])::BIGINT / 4294967296.0 < share),
rw AS (SELECT g, a, b FROM rg UNION ALL SELECT g, b, a FROM rg),
"""
    + _paths_sql("bw", "s1")
    + ",\n"
    + _paths_sql("rw", "s2")
    + ",\n"
    + _world_sql("bw", "s1", "w1")
    + ",\n"
    + _world_sql("rw", "s2", "w2")
    + "\nSELECT w1.g, ROUND((w1.c / NULLIF(w2.c, 0)) / (w1.l / w2.l), 6) + 0.0 AS sigma FROM w1 JOIN w2 USING (g)"
)
def small_worldness(spark, d):
    """Clustering and paths against a random graph drawn by hashes."""
    e, n = _graph(spark, d)
    out = graph.small_worldness(graph.percentile_graph(e, n, ["g"], 0.75), n, ["g"])
    return out.select("g", rnd(F.col("sigma")).alias("sigma"))


FEATURES = ("cycle_duration", "in_duration", "ex_duration", "in_amplitude", "ex_amplitude", "in_area", "ex_area", "duration_ratio", "amplitude_ratio", "area_ratio")
PERCENTS = [v / 100 for v in range(30, 70)]


@query(
    with_(DZ, EXT)
    + f""", ra AS (SELECT chan, i, SUM(COALESCE((x + p) / 2, 0)) OVER (PARTITION BY chan ORDER BY i) AS area FROM (SELECT chan, i, x, LAG(x) OVER (PARTITION BY chan ORDER BY i) AS p FROM zs)),
ea AS (SELECT ext.*, area FROM ext JOIN ra USING (chan, i)),
br AS (SELECT chan, kind, LEAD(kind) OVER w AS k1, i AS i0, LEAD(i) OVER w AS i1, LEAD(i, 2) OVER w AS i2, x AS x0, LEAD(x) OVER w AS x1, LEAD(x, 2) OVER w AS x2, area AS a0, LEAD(area) OVER w AS a1, LEAD(area, 2) OVER w AS a2 FROM ea WINDOW w AS (PARTITION BY chan ORDER BY i)),
pt AS (SELECT chan, (i2 - i0) / 2 AS cycle_duration, (i1 - i0) / 2 AS in_duration, (i2 - i1) / 2 AS ex_duration, x1 - x0 AS in_amplitude, x1 - x2 AS ex_amplitude, a1 - a0 - x0 * (i1 - i0) AS in_area, a2 - a1 - x2 * (i2 - i1) AS ex_area,
  in_duration / ex_duration AS duration_ratio, in_amplitude / ex_amplitude AS amplitude_ratio, in_area / ex_area AS area_ratio FROM br WHERE kind = 'trough' AND k1 = 'peak' AND i2 IS NOT NULL),
nc AS (SELECT chan, GREATEST(COUNT(*) FILTER (kind = 'peak'), COUNT(*) FILTER (kind = 'trough')) AS cycles FROM ext GROUP BY 1),
qs AS (SELECT chan, {", ".join(f"quantile_cont({f}, {PERCENTS}) AS {f}" for f in FEATURES)} FROM pt GROUP BY 1)
SELECT chan, ROUND(list_avg(list_transform(cycle_duration, lambda v: 60 / v)), 4) AS rate_mean, ROUND(list_stddev_pop(list_transform(cycle_duration, lambda v: 60 / v)), 4) AS rate_sd,
{", ".join(f"ROUND(list_avg({f}), 4) AS {f}" for f in FEATURES)}, cycles FROM qs JOIN nc USING (chan)"""
)
def resp_features(spark, d):
    """All measures of breath-like cycles of the daily series, at 2 Hz."""
    s = series.with_stats(daily_series(spark, d), ["chan"], mean=F.avg("x"))
    s = s.select("chan", F.col("i").cast("long").alias("i"), (F.col("x") - F.col("mean")).alias("x"))
    c = cardiac.breath_features(s, ["chan"], 2.0)
    return c.select("chan", *(rnd(F.col(f), 4).alias(f) for f in ("rate_mean", "rate_sd", *FEATURES)), "cycles")


BETWEEN = """st(g, s, t, d) AS (SELECT g, a, b, 1 FROM bw UNION ALL SELECT st.g, st.s, e.b, st.d + 1 FROM st JOIN bw e ON e.g = st.g AND e.a = st.t JOIN s1 ON s1.g = st.g AND s1.a = st.s AND s1.b = e.b AND s1.d = st.d + 1),
ct AS (SELECT g, s, t, ANY_VALUE(d) AS d, COUNT(*) AS c FROM st GROUP BY 1, 2, 3),
nb AS (SELECT g, a AS node, COUNT(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g, a FROM bw)),
th AS (SELECT x.g, x.t AS node, SUM(x.c * y.c / w.c) AS v FROM ct x JOIN ct y ON x.g = y.g AND x.t = y.s AND x.s <> y.t JOIN ct w ON w.g = x.g AND w.s = x.s AND w.t = y.t AND w.d = x.d + y.d GROUP BY 1, 2)
SELECT nb.g, nb.node, ROUND(COALESCE(v, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 6) + 0.0 AS betweenness FROM nb LEFT JOIN th USING (g, node)"""


@query("WITH RECURSIVE " + GRAPH + ",\n" + _paths_sql("bw", "s1") + ",\n" + BETWEEN)
def betweenness_centrality(spark, d):
    """Share of shortest paths through each node."""
    from signalspark.operators import multichannel as mc

    e, n = _graph(spark, d)
    out = mc.betweenness(graph.percentile_graph(e, n, ["g"]), ["g"])
    return out.select("g", "node", rnd(F.col("betweenness")).alias("betweenness"))


@query(with_(SIG) + "SELECT vec_id, ROUND(AVG(GREATEST(x - m, 0)), 6) + 0.0 AS above FROM (SELECT vec_id, x, AVG(x) OVER (PARTITION BY vec_id) AS m FROM sig) GROUP BY 1")
def clipped_mean(spark, d):
    """Mean of what lies above the epoch's mean, the rest clipped to zero."""
    s = series.with_stats(samples(spark, d), ["vec_id"], mean=F.avg("x"))
    return s.groupBy("vec_id").agg(rnd(F.avg(F.greatest(F.col("x") - F.col("mean"), F.lit(0.0)))).alias("above"))


CLEANED = """c0 AS (SELECT label, chan, t, x FROM ch WHERE t < 320 AND chan <> 3),
c1 AS (SELECT label, chan, t, 0.6 * x + 0.4 * COALESCE(LAG(x) OVER (PARTITION BY label, chan ORDER BY t), 0) AS x FROM c0),
c2 AS (SELECT label, chan, t // 4 AS t, AVG(x) AS x FROM c1 GROUP BY 1, 2, 3 HAVING COUNT(*) = 4),
sd AS (SELECT label, chan, STDDEV_POP(x) AS s FROM c2 GROUP BY 1, 2),
lm AS (SELECT label, quantile_cont(s, 0.5) AS m, (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) / 1.35 AS w FROM sd GROUP BY 1),
c3 AS (SELECT c2.* FROM c2 JOIN sd USING (label, chan) JOIN lm USING (label) WHERE NOT (w > 0 AND ABS(s - m) >= 1.5 * w)),
c4 AS (SELECT label, chan, t, x - AVG(x) OVER (PARTITION BY label, t) AS x FROM c3)"""
CLEANING = [("drop_channels", {"names": [3]}), ("crop", {"start": 0, "stop": 320}), ("drop_flat", {}), ("filter", {"taps": [0.6, 0.4]}), ("downsample", {"factor": 4}), ("drop_outliers", {"limit": 1.5}), ("reference", {})]


@query(with_(SIG, BLOCKS, CLEANED) + "SELECT label, chan, t, ROUND(x, 6) + 0.0 AS x FROM c4")
def cleaning_steps(spark, d):
    """An ordered list of steps: crop, channels, filter, resample, outliers, reference."""
    out = clean(_channels(spark, d), ["label"], CLEANING)
    return out.select("label", F.col("chan").cast("long").alias("chan"), F.col("t").cast("long").alias("t"), rnd(F.col("x")).alias("x"))


@query(
    with_(SIG, BLOCKS, CLEANED)
    + " UNION ALL ".join(
        f"SELECT label, {step} AS step, '{name}' AS name, COUNT(DISTINCT chan) AS channels, COUNT(*) AS samples, ROUND(SQRT(AVG(x * x)), 6) + 0.0 AS rms FROM {source} GROUP BY 1"
        for step, name, source in ((0, "input", "ch"), (1, "filter", "(SELECT label, chan, t, 0.6 * x + 0.4 * COALESCE(LAG(x) OVER (PARTITION BY label, chan ORDER BY t), 0) AS x FROM ch)"), (2, "reference", "(SELECT label, chan, t, x - AVG(x) OVER (PARTITION BY label, t) AS x FROM (SELECT label, chan, t, 0.6 * x + 0.4 * COALESCE(LAG(x) OVER (PARTITION BY label, chan ORDER BY t), 0) AS x FROM ch))"))
    )
)
def cleaning_log(spark, d):
    """What each cleaning step leaves."""
    out = run_log(_channels(spark, d), ["label"], [("filter", {"taps": [0.6, 0.4]}), ("reference", {})])
    return out.select("label", "step", "name", "channels", "samples", rnd(F.col("rms")).alias("rms"))
