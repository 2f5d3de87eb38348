"""Queries on the coupling of two kinds of series, with the SQL that checks them.

Users stand for recordings, values of the first type of event for one side and of the last type for the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalspark.functions.arrays import rnd
from signalspark.operators import coupling
from signalspark.plans.inputs import EVT, event_series, with_
from signalspark.plans.registry import query

ALPHAS = [1e2, 1e5, 1e8]
LAGS = [0.0, 7200.0]

SIDES = f"""lf AS (SELECT event_id, user_id AS g, t, x AS y FROM evt WHERE chan = (SELECT MIN(chan) FROM evt)),
rt AS (SELECT user_id AS g, t, x FROM evt WHERE chan = (SELECT MAX(chan) FROM evt)),
qs AS (SELECT lf.*, k, t - lag AS place FROM lf, (VALUES (0, {LAGS[0]}), (1, {LAGS[1]})) v(k, lag)),
b4 AS (SELECT qs.*, rt.t AS t0, rt.x AS v0 FROM qs ASOF LEFT JOIN rt ON qs.g = rt.g AND qs.place >= rt.t)"""

#: From ``ds`` (g, x0, x1, y) to the fit ``ft`` (g, n, al, score, w0, w1, w2), by cofactors of the system of three.
FIT = f"""gr AS (SELECT g, COUNT(*) AS n, SUM(x0 * x0) AS a, SUM(x0 * x1) AS b, SUM(x0) AS c, SUM(x1 * x1) AS d, SUM(x1) AS e, COUNT(*)::DOUBLE AS f, SUM(x0 * y) AS p, SUM(x1 * y) AS q, SUM(y) AS r FROM ds GROUP BY g),
pn AS (SELECT g, n, al, a + al AS a, b, c, d + al AS d, e, f + al AS f, p, q, r FROM gr, (VALUES {", ".join(f"({a}::DOUBLE)" for a in ALPHAS)}) v(al)),
dt AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM pn),
iv AS (SELECT *, (d * f - e * e) / det AS i00, (c * e - b * f) / det AS i01, (b * e - c * d) / det AS i02, (a * f - c * c) / det AS i11, (b * c - a * e) / det AS i12, (a * d - b * b) / det AS i22 FROM dt),
ws AS (SELECT *, i00 * p + i01 * q + i02 * r AS w0, i01 * p + i11 * q + i12 * r AS w1, i02 * p + i12 * q + i22 * r AS w2 FROM iv),
lo AS (SELECT ws.g, al, n, w0, w1, w2, AVG(POW((y - w0 * x0 - w1 * x1 - w2) / (1 - (x0 * (i00 * x0 + 2 * i01 * x1 + 2 * i02) + x1 * (i11 * x1 + 2 * i12) + i22)), 2)) AS score FROM ws JOIN ds ON ws.g = ds.g GROUP BY ALL),
ft AS (SELECT * FROM lo QUALIFY ROW_NUMBER() OVER (PARTITION BY g ORDER BY score, al) = 1)"""


def _sides(spark, d):
    """(events of the first type, series of the last type named x)."""
    e = event_series(spark, d)
    first, last = e.agg(F.min("chan"), F.max("chan")).first()
    left = e.where(F.col("chan") == first).select(F.col("user_id").alias("g"), "t", "event_id", F.col("x").alias("y"))
    return left, e.where(F.col("chan") == last).select(F.col("user_id").alias("g"), F.lit("x").alias("name"), "t", "x")


@query(
    with_(
        EVT,
        SIDES,
        "fo AS (SELECT b4.*, CASE WHEN t0 = rt.t THEN v0 ELSE v0 + (rt.x - v0) * (place - t0) / (rt.t - t0) END AS v FROM b4 ASOF LEFT JOIN rt ON b4.g = rt.g AND b4.place <= rt.t)",
        "wd AS (SELECT event_id, g, y, MAX(v) FILTER (WHERE k = 0) AS x0, MAX(v) FILTER (WHERE k = 1) AS x1 FROM fo GROUP BY ALL)",
        "ds AS (SELECT * FROM wd WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND y IS NOT NULL)",
        FIT,
    )
    + "SELECT event_id, ds.g, n, al AS alpha, ROUND(score, 4) + 0.0 AS score, ROUND(w0 * x0 + w1 * x1 + w2, 6) + 0.0 AS yhat FROM ds JOIN ft ON ds.g = ft.g"
)
def heart_to_brain(spark, d):
    """One series from another at two lags, between its values; the penalty by leaving out each row, of a single row by the rounding of its errors."""
    left, series = _sides(spark, d)
    rows, model = coupling.heart_to_brain(left, series, ["g"], ["x"], LAGS, ALPHAS, computed=True)
    m = model.select("g", "n", "alpha", F.array_min("scores").alias("score"))
    return rows.join(m, "g").select("event_id", "g", "n", "alpha", rnd(F.col("score"), 4).alias("score"), rnd(F.col("yhat")).alias("yhat"))


@query(
    with_(
        EVT,
        SIDES,
        "f1 AS (SELECT g, MIN_BY(x, t) AS x FROM rt GROUP BY g)",
        "wd AS (SELECT event_id, b4.g, y, MAX(COALESCE(v0, f1.x)) FILTER (WHERE k = 0) AS x0, MAX(COALESCE(v0, f1.x)) FILTER (WHERE k = 1) AS x1 FROM b4 JOIN f1 ON b4.g = f1.g WHERE y IS NOT NULL GROUP BY ALL)",
        "ds AS (SELECT g, x0, x1, COALESCE((y - AVG(y) OVER (PARTITION BY g)) / NULLIF(STDDEV_POP(y) OVER (PARTITION BY g), 0), 0) AS y FROM wd)",
        FIT,
    )
    + "SELECT g, 'y' AS target, 'x' AS band, ROUND(ABS(w0) + ABS(w1), 9) + 0.0 AS coupling, al AS alpha, n FROM ft"
)
def brain_to_heart(spark, d):
    """Weights, summed over two lags, of one series in the other."""
    left, series = _sides(spark, d)
    out = coupling.brain_to_heart(left, series, ["g"], ["x"], LAGS, ["y"], ALPHAS)
    return out.select("g", "target", "band", rnd(F.col("coupling"), 9).alias("coupling"), "alpha", "n")
