"""Queries on connectivity, graphs, statistics and relational idioms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalspark.functions.arrays import rnd
from signalspark.operators import cleaning, connectivity, graph, joins, series, stats
from signalspark.plans.inputs import EVT, SIG, event_series, samples, table, with_
from signalspark.plans.registry import query

HOURLY = """hr AS (SELECT user_id % 10 AS g, chan, FLOOR(t / 3600)::BIGINT AS h, AVG(x) AS x FROM evt GROUP BY 1, 2, 3),
ed AS (SELECT a.g, a.chan AS a, b.chan AS b, COUNT(*) AS n, corr(a.x, b.x) AS r FROM hr a JOIN hr b ON a.g = b.g AND a.h = b.h AND a.chan < b.chan GROUP BY 1, 2, 3)"""


def _hourly(spark, d):
    """Hourly means per group of users and type of event."""
    e = event_series(spark, d).withColumn("g", F.col("user_id") % 10)
    return e.groupBy("g", "chan", F.floor(F.col("t") / 3600).alias("h")).agg(F.avg("x").alias("x"))


@query(with_(EVT, HOURLY) + "SELECT g, a, b, n, ROUND(r, 6) + 0.0 AS r FROM ed")
def pairwise_corr(spark, d):
    """Correlations of hourly means between types of event."""
    c = connectivity.correlation(_hourly(spark, d), ["g"], "chan", "h")
    return c.select("g", "a", "b", "n", rnd(F.col("r")).alias("r"))


@query(
    with_(EVT, HOURLY)
    + "SELECT a.g, a.chan AS a, b.chan AS b, ROUND(COVAR_SAMP(a.x, b.x), 6) + 0.0 AS cov FROM hr a JOIN hr b ON a.g = b.g AND a.h = b.h AND a.chan <= b.chan GROUP BY 1, 2, 3"
)
def covariance_matrix(spark, d):
    c = connectivity.covariance(_hourly(spark, d), ["g"], "chan", "h")
    return c.select("g", "a", "b", rnd(F.col("cov")).alias("cov"))


@query(
    with_(EVT, HOURLY)
    + """, rk AS (SELECT g, chan, h, PERCENT_RANK() OVER (PARTITION BY g, chan ORDER BY x) AS x FROM hr),
rr AS (SELECT a.g, a.chan AS a, b.chan AS b, corr(a.x, b.x) AS r FROM rk a JOIN rk b ON a.g = b.g AND a.h = b.h AND a.chan < b.chan GROUP BY 1, 2, 3)
SELECT g, a, b, CASE WHEN 1 - r * r > 1e-12 THEN ROUND(-0.5 * LOG2(1 - r * r), 6) + 0.0 END AS mi FROM rr"""
)
def gaussian_mi(spark, d):
    m = connectivity.gaussian_mi(_hourly(spark, d), ["g"], "chan", "h")  # null where the ranks agree wholly
    return m.select("g", "a", "b", rnd(F.col("mi")).alias("mi"))


@query(
    with_(EVT)
    + """, s AS (SELECT user_id % 10 AS g, chan, FLOOR(t / 3600)::BIGINT AS h, AVG(x * COS(t / 5000)) AS re, AVG(x * SIN(t / 5000)) AS im FROM evt GROUP BY 1, 2, 3),
p AS (SELECT a.g, a.chan AS a, b.chan AS b, a.re * b.re + a.im * b.im AS sr, a.im * b.re - a.re * b.im AS si, a.re * a.re + a.im * a.im AS pa, b.re * b.re + b.im * b.im AS pb FROM s a JOIN s b ON a.g = b.g AND a.h = b.h AND a.chan < b.chan),
m AS (SELECT g, a, b, AVG(sr) AS sr, AVG(si) AS si, AVG(sr / SQRT(sr * sr + si * si)) AS ur, AVG(si / SQRT(sr * sr + si * si)) AS ui, AVG(pa) AS pa, AVG(pb) AS pb, AVG(SIGN(si)) AS sg, AVG(ABS(si)) AS sz FROM p GROUP BY 1, 2, 3)
SELECT g, a, b, ROUND(SQRT(sr * sr + si * si) / SQRT(pa * pb), 6) + 0.0 AS coh, ROUND(SQRT(ur * ur + ui * ui), 6) + 0.0 AS plv, ROUND(ABS(ui) / SQRT(1 - ur * ur), 6) + 0.0 AS ciplv,
ROUND(ABS(sg), 6) + 0.0 AS pli, ROUND(ABS(si) / sz, 6) + 0.0 AS wpli FROM m"""
)
def phase_connectivity(spark, d):
    """Coherence and phase-locking measures of hourly complex signals."""
    e = event_series(spark, d).withColumn("g", F.col("user_id") % 10)
    s = e.groupBy("g", "chan", F.floor(F.col("t") / 3600).alias("h")).agg(F.avg(F.col("x") * F.cos(F.col("t") / 5000)).alias("re"), F.avg(F.col("x") * F.sin(F.col("t") / 5000)).alias("im"))
    m = connectivity.phase_metrics(s, ["g"], "chan", "h")
    return m.select("g", "a", "b", *(rnd(F.col(c)).alias(c) for c in ("coh", "plv", "ciplv", "pli", "wpli")))


@query(
    """WITH ep AS (SELECT vec_id // 4 AS g, vec_id % 4 AS chan, UNNEST(embedding)::DOUBLE AS x, UNNEST(range(64)) AS i FROM embeddings),
fq AS (SELECT k, 4 * POW(24 / 4.0, k / 14.0) AS f, FLOOR(3 * POW(12 / 3.0, k / 14.0) + 1e-9) AS cyc FROM range(15) t(k)),
sg AS (SELECT k, f, cyc / (2 * PI() * f) AS sigma FROM fq),
wv AS (SELECT k, f, j, EXP(-POW(j / 64.0, 2) / (2 * sigma * sigma)) AS e FROM (SELECT *, UNNEST(range(-CEIL(5 * sigma * 64)::BIGINT, CEIL(5 * sigma * 64)::BIGINT + 1)) AS j FROM sg)),
ww AS (SELECT k, f, j, e / SQRT(SUM(e * e) OVER (PARTITION BY k)) AS e FROM wv),
cf AS (SELECT g, chan, k, p, SUM(x * e * COS(2 * PI() * f * j / 64)) AS re, SUM(x * e * SIN(2 * PI() * f * j / 64)) AS im FROM ep, ww, LATERAL (SELECT i + j AS p) WHERE p BETWEEN 0 AND 63 AND p % 3 = 0 GROUP BY ALL),
pr AS (SELECT a.g, a.k, a.chan AS a, b.chan AS b, a.re * b.re + a.im * b.im AS sr, a.im * b.re - a.re * b.im AS si, a.re * a.re + a.im * a.im AS pa, b.re * b.re + b.im * b.im AS pb FROM cf a JOIN cf b ON a.g = b.g AND a.k = b.k AND a.p = b.p AND a.chan < b.chan),
m AS (SELECT g, k, a, b, AVG(sr) AS sr, AVG(si) AS si, AVG(sr / SQRT(sr * sr + si * si)) AS ur, AVG(si / SQRT(sr * sr + si * si)) AS ui, AVG(pa) AS pa, AVG(pb) AS pb, AVG(SIGN(si)) AS sg, AVG(ABS(si)) AS sz FROM pr GROUP BY ALL),
bn AS (SELECT * FROM (VALUES ('Theta', 4.0, 8.0), ('Alpha', 8.0, 12.0), ('Beta', 12.0, 23.9)) v(band, fmin, fmax))
SELECT g, band, a, b, ROUND(AVG(SQRT(sr * sr + si * si) / SQRT(pa * pb)), 6) + 0.0 AS coh, ROUND(AVG(SQRT(ur * ur + ui * ui)), 6) + 0.0 AS plv, ROUND(AVG(ABS(ui) / SQRT(1 - ur * ur)), 6) + 0.0 AS ciplv, ROUND(AVG(ABS(sg)), 6) + 0.0 AS pli, ROUND(AVG(ABS(si) / sz), 6) + 0.0 AS wpli
FROM m JOIN fq USING (k) JOIN bn ON f BETWEEN fmin AND fmax GROUP BY g, band, a, b"""
)
def wavelet_connectivity(spark, d):
    """Coherence and phase measures of wavelet coefficients at 15 frequencies, as means of bands."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("g"), (F.col("vec_id") % 4).alias("chan"), F.col("embedding").alias("x"))
    bands = spark.createDataFrame([("Theta", 4.0, 8.0), ("Alpha", 8.0, 12.0), ("Beta", 12.0, 23.9)], "band string, fmin double, fmax double")
    m = connectivity.wavelet_connectivity(e, ["g"], "chan", 64.0, bands, 4.0, 24.0)
    return m.select("g", "band", "a", "b", *(rnd(F.col(c)).alias(c) for c in connectivity.MEASURES))


@query(with_(EVT, HOURLY) + "SELECT g, ROUND(MAX(r) FILTER (a || '_' || b = 'click_view'), 6) + 0.0 AS r_click_view, ROUND(MAX(r) FILTER (a || '_' || b = 'click_purchase'), 6) + 0.0 AS r_click_purchase FROM ed GROUP BY 1")
def pivot_features(spark, d):
    """Edges as columns of a wide table."""
    c = connectivity.correlation(_hourly(spark, d), ["g"], "chan", "h")
    p = connectivity.pair_columns(c, ["g"], [("click", "view"), ("click", "purchase")], "r", "r")
    return p.select("g", *(rnd(F.col(x)).alias(x) for x in ("r_click_view", "r_click_purchase")))


BLOCKS = """pr AS (SELECT label, vec_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS c FROM embeddings),
ch AS (SELECT s.label, (pr.c % 8)::INT AS chan, (pr.c // 8) * 64 + s.i AS t, s.x FROM sig s JOIN pr USING (vec_id))"""


def _channels(spark, d):
    """(label, chan, t, x): the epochs of each class dealt to eight channels, end to end."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, d, "embeddings").select("label", "vec_id", place.alias("c"))
    s = samples(spark, d).select("vec_id", "i", "x").join(e, "vec_id")
    return s.select("label", (F.col("c") % 8).alias("chan"), (F.floor(F.col("c") / 8) * 64 + F.col("i")).alias("t"), "x")


@query(
    with_(SIG, BLOCKS)
    + "SELECT a.label, a.t // 128 AS block, a.chan AS a, b.chan AS b, ROUND(SUM(a.x * b.x) / 128, 6) + 0.0 AS cov FROM ch a JOIN ch b ON a.label = b.label AND a.t = b.t AND a.chan <= b.chan GROUP BY 1, 2, 3, 4"
)
def block_cov(spark, d):
    """Covariances of channels in blocks of 128 samples."""
    c = connectivity.block_covariance(_channels(spark, d), ["label"], "chan", "t", 128)
    return c.select("label", "block", "a", "b", rnd(F.col("cov")).alias("cov"))


GRAPH = """nd AS (SELECT DISTINCT o_orderpriority AS g, o_custkey % 40 AS node FROM orders),
od AS (SELECT DISTINCT o_orderpriority AS g, o_custkey % 40 AS node, (o_orderdate::DATE - DATE '1992-01-01') // 7 AS wk FROM orders),
we AS (SELECT a.g, a.node AS a, b.node AS b, COUNT(*)::DOUBLE AS w FROM od a JOIN od b ON a.g = b.g AND a.wk = b.wk AND a.node < b.node GROUP BY 1, 2, 3),
nn AS (SELECT g, COUNT(*) AS n FROM nd GROUP BY 1),
zz AS (SELECT g, w FROM we UNION ALL SELECT g, 0.0 FROM (SELECT nn.g, UNNEST(range(0, n * n - (SELECT COUNT(*) FROM we WHERE we.g = nn.g))) FROM nn)),
lm AS (SELECT g, quantile_cont(w, 0.9) AS lim FROM zz GROUP BY 1),
ge AS (SELECT we.* FROM we JOIN lm USING (g) WHERE w > lim),
bw AS (SELECT g, a, b FROM ge UNION ALL SELECT g, b, a FROM ge)"""


def _graph(spark, d):
    """Weighted graph of groups of customers that order in the same weeks, by priority; its nodes."""
    o = table(spark, d, "orders")
    wk = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 7).alias("wk")
    seen = o.select(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 40).alias("node"), wk).distinct()
    nodes = seen.select("g", "node").distinct()
    other = seen.select("g", "wk", F.col("node").alias("b"))
    w = seen.select("g", "wk", F.col("node").alias("a")).join(other, ["g", "wk"]).where("a < b")
    return w.groupBy("g", "a", "b").agg(F.count("*").cast("double").alias("w")), nodes


@query(with_(GRAPH) + "SELECT g, a, b, w FROM ge")
def percentile_graph(spark, d):
    """Edges above the 90th percentile of the whole matrix."""
    e, n = _graph(spark, d)
    return graph.percentile_graph(e, n, ["g"])


@query(with_(GRAPH) + "SELECT nd.g, nd.node, COUNT(bw.b) AS degree, ROUND(COUNT(bw.b) / (MAX(n) - 1), 6) + 0.0 AS centrality FROM nd JOIN nn USING (g) LEFT JOIN bw ON bw.g = nd.g AND bw.a = nd.node GROUP BY 1, 2")
def degree_centrality(spark, d):
    e, n = _graph(spark, d)
    c = graph.degree_centrality(graph.percentile_graph(e, n, ["g"]), n, ["g"])
    return c.select("g", "node", "degree", rnd(F.col("centrality")).alias("centrality"))


@query(
    with_(GRAPH)
    + """, dg AS (SELECT g, a AS node, COUNT(*) AS k FROM bw GROUP BY 1, 2),
tr AS (SELECT x.g, x.a AS node, COUNT(*) / 2 AS t FROM bw x JOIN bw y ON x.g = y.g AND x.b = y.a JOIN bw z ON y.g = z.g AND y.b = z.a AND z.b = x.a GROUP BY 1, 2)
SELECT nd.g, nd.node, ROUND(CASE WHEN COALESCE(k, 0) < 2 THEN 0 ELSE 2.0 * COALESCE(t, 0) / (k * (k - 1)) END, 6) + 0.0 AS clustering FROM nd LEFT JOIN dg USING (g, node) LEFT JOIN tr USING (g, node)"""
)
def clustering_coeff(spark, d):
    e, n = _graph(spark, d)
    c = graph.clustering(graph.percentile_graph(e, n, ["g"]), n, ["g"])
    return c.select("g", "node", rnd(F.col("clustering")).alias("clustering"))


@query(
    "WITH RECURSIVE "
    + GRAPH
    + """, path(g, a, b, d) AS (SELECT g, a, b, 1 FROM bw UNION SELECT p.g, p.a, bw.b, p.d + 1 FROM path p JOIN bw ON bw.g = p.g AND bw.a = p.b WHERE p.d < 40),
sh AS (SELECT g, a, b, MIN(d) AS d FROM path WHERE a <> b GROUP BY 1, 2, 3)
SELECT nn.g, ROUND(COALESCE(SUM(1.0 / d), 0) / (MAX(n) * (MAX(n) - 1)), 6) + 0.0 AS efficiency FROM nn LEFT JOIN sh USING (g) GROUP BY 1"""
)
def global_efficiency(spark, d):
    e, n = _graph(spark, d)
    c = graph.global_efficiency(graph.percentile_graph(e, n, ["g"]), n, ["g"])
    return c.select("g", rnd(F.col("efficiency")).alias("efficiency"))


@query(
    with_(GRAPH)
    + "SELECT nd.g, nd.node, ROUND(COALESCE(SUM(w), 0) / MAX(n), 6) + 0.0 AS intensity FROM nd JOIN nn USING (g) LEFT JOIN (SELECT g, a, w FROM we UNION ALL SELECT g, b, w FROM we) u ON u.g = nd.g AND u.a = nd.node GROUP BY 1, 2"
)
def chan_intensity(spark, d):
    e, n = _graph(spark, d)
    c = graph.intensity(e, n, ["g"])
    return c.select("g", "node", rnd(F.col("intensity")).alias("intensity"))


@query(
    "WITH RECURSIVE "
    + GRAPH
    + """, reach(g, a, b) AS (SELECT g, node, node FROM nd UNION SELECT r.g, r.a, bw.b FROM reach r JOIN bw ON bw.g = r.g AND bw.a = r.b)
SELECT g, a AS node, MIN(b) AS component FROM reach GROUP BY 1, 2"""
)
def graph_components(spark, d):
    e, n = _graph(spark, d)
    return graph.components(graph.percentile_graph(e, n, ["g"]), n, ["g"])


MODELS = "md AS (SELECT c_custkey AS item, 1 AS model, c_nationkey AS label FROM customer UNION ALL SELECT c_custkey, 2, c_custkey % 50 FROM customer UNION ALL SELECT c_custkey, 3, FLOOR(c_acctbal / 200)::BIGINT FROM customer)"


@query(with_(MODELS) + "SELECT a.item AS a, b.item AS b, ROUND(COUNT(*) / 3, 6) + 0.0 AS share FROM md a JOIN md b ON a.model = b.model AND a.label = b.label AND a.item < b.item GROUP BY 1, 2")
def coassociation(spark, d):
    """How often three groupings of the customers agree."""
    c = table(spark, d, "customer")
    ways = {1: F.col("c_nationkey"), 2: F.col("c_custkey") % 50, 3: F.floor(F.col("c_acctbal") / 200)}
    m = c.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("model"), v.cast("long").alias("label")) for k, v in ways.items()))).alias("m"))
    return graph.coassociation(m.select(F.col("c_custkey").alias("item"), "m.model", "m.label"), "item", "model", "label", shown=rnd)


TRIPLES = "tp AS (SELECT c_custkey AS id, 0.9 * SIN(c_custkey) AS xy, 0.9 * SIN(2 * c_custkey) AS xz, 0.5 * COS(c_custkey) AS yz, 20 + c_custkey % 80 AS n FROM customer)"


def _triples(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (0.9 * F.sin(k)).alias("xy"), (0.9 * F.sin(2 * k)).alias("xz"), (0.5 * F.cos(k)).alias("yz"), (20 + k % 80).alias("n"))


@query(
    with_(TRIPLES)
    + """SELECT id, ROUND((xy - xz) * SQRT((n - 1) * (1 + yz) / (2 * (n - 1) / (n - 3) * (1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz) + POWER((xy + xz) / 2, 2) * POWER(1 - yz, 3))), 6) + 0.0 AS t
FROM tp WHERE 1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz > 0"""
)
def steiger_t(spark, d):
    """Test of two dependent correlations; triples that no data can have are left out."""
    xy, xz, yz, n = (F.col(c) for c in ("xy", "xz", "yz", "n"))
    ok = 1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz > 0
    return _triples(spark, d).where(ok).select("id", rnd(stats.steiger_t(xy, xz, yz, n)).alias("t"))


@query(with_(TRIPLES) + "SELECT id, ROUND(ABS(ATANH(xy) - ATANH(xz)) / SQRT(1.0 / (n - 3) + 1.0 / (n + 7)), 6) + 0.0 AS z FROM tp")
def fisher_z(spark, d):
    """Test of two independent correlations."""
    return _triples(spark, d).select("id", rnd(stats.fisher_z(F.col("xy"), F.col("xz"), F.col("n"), F.col("n") + 10)).alias("z"))


@query(
    with_(TRIPLES)
    + """, l AS (SELECT *, TANH(ATANH(xy) - 1.959963984540054 / SQRT(n - 3)) AS l1, TANH(ATANH(xy) + 1.959963984540054 / SQRT(n - 3)) AS u1, TANH(ATANH(xz) - 1.959963984540054 / SQRT(n + 7)) AS l2, TANH(ATANH(xz) + 1.959963984540054 / SQRT(n + 7)) AS u2 FROM tp)
SELECT id, ROUND(xy - xz - SQRT(POWER(xy - l1, 2) + POWER(u2 - xz, 2)), 6) + 0.0 AS low, ROUND(xy - xz + SQRT(POWER(u1 - xy, 2) + POWER(xz - l2, 2)), 6) + 0.0 AS high FROM l"""
)
def zou_interval(spark, d):
    low, high = stats.zou_independent(F.col("xy"), F.col("xz"), F.col("n"), F.col("n") + 10)
    return _triples(spark, d).select("id", rnd(low).alias("low"), rnd(high).alias("high"))


@query("SELECT c_custkey, DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def label_encode(spark, d):
    c = stats.label_encode(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return c.select("c_custkey", F.col("code").cast("long").alias("code"))


@query(
    with_(EVT)
    + "SELECT user_id, event_id FROM (SELECT user_id, event_id, COUNT(chan) OVER w AS c, MIN(chan) OVER w AS a, MAX(chan) OVER w AS b FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE c = 3 AND a = b"
)
def window_purity(spark, d):
    """Ends of windows of three events of one type."""
    return stats.pure_windows(event_series(spark, d), ["user_id"], "t", "chan", 3).select("user_id", "event_id")


@query(
    with_(EVT)
    + """, o AS (SELECT user_id, chan, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t) AS p FROM evt)
SELECT a.user_id, a.chan AS u, b.chan AS v, COUNT(*) AS n, ROUND(POWER(AVG(EXP(-2.0 * (b.p - a.p))), 0.5), 6) + 0.0 AS weight FROM o a JOIN o b ON a.user_id = b.user_id AND b.p > a.p GROUP BY 1, 2, 3"""
)
def sequence_graph_transform(spark, d):
    s = stats.sequence_graph(event_series(spark, d), ["user_id"], "t", "chan", 2.0)
    return s.select("user_id", "u", "v", "n", rnd(F.col("weight")).alias("weight"))


@query(with_(EVT) + "SELECT event_id, ROUND((RANK() OVER (PARTITION BY chan ORDER BY x) - 0.5) / COUNT(x) OVER (PARTITION BY chan), 6) + 0.0 AS q FROM evt")
def quantile_transform(spark, d):
    """Values as ranks between 0 and 1 within their type."""
    q = stats.quantile_rank(event_series(spark, d), ["chan"], "x")
    return q.select("event_id", rnd(F.col("q")).alias("q"))


@query(
    with_(
        EVT,
        "dr AS (SELECT chan, x, k, ('0x' || md5(event_id::VARCHAR || ':' || k::VARCHAR)[1:8])::BIGINT / 4294967296.0 AS u FROM evt, (SELECT UNNEST(range(0, 20)) AS k))",
        "p AS (SELECT *, (SELECT COUNT(*) FROM (VALUES (0.36787944117144233), (0.7357588823428847), (0.9196986029286058), (0.9810118431238462), (0.9963401531726563), (0.9994058151824183), (0.9999167588507119), (0.9999897508033253)) v(c) WHERE dr.u >= v.c) AS times FROM dr)",
    )
    + "SELECT chan, k::INT AS draw, ROUND(SUM(x * times) / SUM(times), 6) + 0.0 AS mean FROM p GROUP BY 1, 2"
)
def bootstrap_erp(spark, d):
    """Bootstrap means of each type, twenty draws."""
    b = stats.bootstrap_means(event_series(spark, d), ["chan"], "event_id", "x", 20)
    return b.select("chan", "draw", rnd(F.col("mean")).alias("mean"))


@query(with_(EVT) + "SELECT user_id, ROUND(SUM(-p * LOG2(p)), 6) + 0.0 AS entropy FROM (SELECT user_id, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY user_id) AS p FROM evt GROUP BY user_id, chan) GROUP BY 1")
def category_entropy(spark, d):
    e = stats.entropy_of(event_series(spark, d), ["user_id"], "chan")
    return e.select("user_id", rnd(F.col("entropy")).alias("entropy"))


@query("SELECT event_id FROM events WHERE (user_id, event_type, ts::DATE) IN (SELECT (user_id, event_type, ts::DATE) FROM events GROUP BY user_id, event_type, ts::DATE HAVING COUNT(*) = 1)")
def drop_all_duplicates(spark, d):
    """Events that are the only ones of their type and user on their day."""
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return joins.drop_all_duplicates(e, ["user_id", "event_type", "day"]).select("event_id")


@query(
    """WITH c AS (SELECT c_nationkey AS g, c_custkey AS component, ROUND(0.5 + 0.5 * SIN(c_custkey), 3) AS prob, COUNT(*) OVER (PARTITION BY c_nationkey) AS chans FROM customer)
SELECT g, component, prob FROM (SELECT *, COUNT(*) OVER w AS taken, SUM(1 - prob) OVER w AS lost FROM c WHERE prob >= 0.6 WINDOW w AS (PARTITION BY g ORDER BY prob DESC RANGE UNBOUNDED PRECEDING)) WHERE taken <= chans * 0.25 AND ROUND(lost, 9) <= 3"""
)
def adaptive_threshold(spark, d):
    """Components by falling probability, up to a quarter of the channels and three expected mistakes."""
    c = table(spark, d, "customer")
    prob = F.round(0.5 + 0.5 * F.sin("c_custkey"), 3).alias("prob")
    c = c.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("component"), prob)
    c = series.with_stats(c, ["g"], chans=F.count("*"))
    return cleaning.adaptive_threshold(c, ["g"], 0.25, 3.0 + 1e-9, 0.6).select("g", "component", "prob")


@query("SELECT o_orderpriority AS chan, STDDEV_POP(o_totalprice) < 1e-15 AS flat, COUNT(*) AS n FROM orders GROUP BY 1")
def flat_channels(spark, d):
    """Whether channels are flat."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("chan"), "o_totalprice")
    flat = cleaning.flat_channels(o, ["chan"], "o_totalprice").select("chan", F.lit(True).alias("flat"))
    n = o.groupBy("chan").agg(F.count("*").alias("n"))
    return n.join(flat, "chan", "left").select("chan", F.coalesce("flat", F.lit(False)).alias("flat"), "n")


@query(
    """SELECT s.s_suppkey, n.n_name AS site, CASE WHEN contains(lower(r.r_name), 'asia') THEN 'EEG' WHEN contains(lower(r.r_name), 'europe') THEN 'ECG' ELSE 'MISC' END AS type
FROM supplier s JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey"""
)
def montage_join(spark, d):
    """Channels with site and type from small dimension tables."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    name = F.lower("r_name")
    kind = F.when(F.contains(name, F.lit("asia")), "EEG").when(F.contains(name, F.lit("europe")), "ECG").otherwise("MISC")
    return out.select("s_suppkey", F.col("n_name").alias("site"), kind.alias("type"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) NOT IN (SELECT lower(c_mktsegment) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def name_standardise_anti(spark, d):
    """Rows whose name, upper or lower case, is not in a list."""
    c = table(spark, d, "customer")
    known = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.lower("c_mktsegment").alias("name")).distinct()
    return c.join(known, F.lower("c_mktsegment") == known["name"], "left_anti").select("c_custkey")


@query(
    """SELECT event_id, CASE stage WHEN 'W' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'R' THEN 4 END AS code FROM (
SELECT event_id, replace(replace(replace('SLEEP-' || CASE event_id % 5 WHEN 0 THEN 'S0' WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' WHEN 3 THEN 'S3' ELSE 'REM' END, 'SLEEP-', ''), 'S0', 'W'), 'REM', 'R') AS s0, replace(s0, 'S', 'N') AS stage FROM events)"""
)
def stage_relabel(spark, d):
    """Sleep stages from event names, by ordered replacements."""
    from signalspark.sources.sleep import stage_code

    raw = F.element_at(F.array(*map(F.lit, ("SLEEP-S0", "SLEEP-S1", "SLEEP-S2", "SLEEP-S3", "SLEEP-REM"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", stage_code(raw).alias("code"))


@query("SELECT l_orderkey, l_linenumber, ROUND((raw * 0.25 - 10)::DOUBLE, 6) + 0.0 AS value, FLOOR((raw * 0.25 - 10 + 10) / 0.25 + 0.5)::BIGINT AS back FROM (SELECT l_orderkey, l_linenumber, GREATEST(-100, LEAST(100, l_quantity::BIGINT * 3)) AS raw FROM lineitem)")
def calibration_affine(spark, d):
    """Raw samples clamped to the digital range, calibrated and taken back."""
    from signalspark.sources.sleep import clamp, from_raw, to_raw

    raw = clamp(F.col("l_quantity").cast("long") * 3, -100, 100)
    v = from_raw(raw, 0.25, -10.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(v).alias("value"), to_raw(v, 0.25, -10.0).alias("back"))


@query("SELECT p_partkey, 'W' || CASE WHEN p_size < 30 THEN 'q' WHEN p_size < 60 THEN '1' ELSE '2' END || lpad(p_size::VARCHAR, 4, '0') || lpad((p_partkey % 100)::VARCHAR, 3, '0') AS code FROM part")
def param_string(spark, d):
    """Device parameters as a padded string."""
    size, key = F.col("p_size").cast("string"), (F.col("p_partkey") % 100).cast("string")
    bucket = F.when(F.col("p_size") < 30, "q").when(F.col("p_size") < 60, "1").otherwise("2")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("W"), bucket, F.lpad(size, 4, "0"), F.lpad(key, 3, "0")).alias("code"))


@query("SELECT doc_id, (LENGTH(text) - LENGTH(replace(text, 'the', ''))) // 3 AS n FROM documents")
def find_tokens(spark, d):
    """Occurrences of a token in texts."""
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("the")).cast("long").alias("n"))


@query("SELECT 'customer' AS origin, c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, COUNT(*) FROM supplier GROUP BY 2")
def union_all_long(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).count().withColumn("origin", F.lit("customer"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).count().withColumn("origin", F.lit("supplier"))
    return a.unionByName(b).select("origin", "k", F.col("count").alias("n"))


@query("SELECT event_type, max_by(event_id, value) AS top, min_by(event_id, value) AS low FROM events GROUP BY 1")
def arg_extremes(spark, d):
    """Events of greatest and least value; of equal values the least event_id, which the SQL leaves open."""
    known = F.when(F.col("value").isNotNull() & F.col("event_id").isNotNull(), F.col("value"))
    top = F.max_by("event_id", F.when(known.isNotNull(), F.struct(known.alias("v"), (-F.col("event_id")).alias("id"))))
    low = F.min_by("event_id", F.when(known.isNotNull(), F.struct(known.alias("v"), F.col("event_id").alias("id"))))
    return table(spark, d, "events").groupBy("event_type").agg(top.alias("top"), low.alias("low"))


@query(with_(EVT) + "SELECT user_id, event_id, r FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY x DESC, event_id) AS r FROM evt) WHERE r <= 3")
def top_k_events(spark, d):
    """The three largest values of each user: a top-k report."""
    w = Window.partitionBy("user_id").orderBy(F.desc("x"), "event_id")
    e = event_series(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3")
    return e.select("user_id", "event_id", F.col("r").cast("long").alias("r"))


@query(
    with_(SIG)
    + ", w AS (SELECT i AS chan, (k + 1) AS comp, COS((k + 1) * (i + 0.5) * PI() / 64) / 32 AS w FROM (SELECT UNNEST(range(0, 64)) AS i), (SELECT UNNEST(range(0, 4)) AS k)) "
    + "SELECT vec_id, comp, ROUND(SUM(x * w.w), 6) + 0.0 AS x FROM sig JOIN w ON w.chan = sig.i GROUP BY 1, 2"
)
def apply_weights(spark, d):
    """Components as weighted sums, the matrix product as a join."""
    import math

    w = spark.range(64).select(F.col("id").cast("int").alias("chan"), F.explode(F.array(*(F.struct(F.lit(k).alias("comp"), (F.cos(k * (F.col("id") + 0.5) * math.pi / 64) / 32).alias("w")) for k in range(1, 5)))).alias("c"))
    w = w.select("chan", "c.comp", "c.w")
    s = samples(spark, d).select("vec_id", F.col("i").alias("chan"), F.lit(0).alias("i"), "x")
    out = cleaning.apply_weights(s, w, ["vec_id"], "chan", "comp")
    return out.select("vec_id", F.col("comp").cast("long").alias("comp"), rnd(F.col("x")).alias("x"))
