"""Queries in SQL with the functions that ``functions.sql`` gives a session."""

from __future__ import annotations

from signalspark.functions import sql
from signalspark.plans import catalog_epochs  # noqa: F401  its checks are put together here
from signalspark.plans.inputs import SUP, epochs, supplier_series, with_
from signalspark.plans.registry import ORACLES, query

def _rounded(expr: str) -> str:
    return f"round({expr}, 6) + 0D"


@query(
    f"""SELECT h.vec_id, h.activity, h.mobility, h.complexity, pe.pe, pf.fd AS petrosian, kf.fd AS katz, ac.acw
FROM ({ORACLES["hjorth"]}) h JOIN ({ORACLES["perm_entropy"]}) pe USING (vec_id) JOIN ({ORACLES["petrosian_fd"]}) pf USING (vec_id)
JOIN ({ORACLES["katz_fd"]}) kf USING (vec_id) JOIN ({ORACLES["acw"]}) ac USING (vec_id)"""
)
def sql_features(spark, d):
    """Measures of every epoch by SQL functions alone."""
    sql.register(spark)
    fields = {"activity": "sig_hjorth(x).activity", "mobility": "sig_hjorth(x).mobility", "complexity": "sig_hjorth(x).complexity"}
    fields |= {"pe": "sig_permutation_entropy(x)", "petrosian": "sig_petrosian_fd(x)", "katz": "sig_katz_fd(x)", "acw": "sig_acw(x, 64D)"}
    return spark.sql(f"SELECT vec_id, {', '.join(f'{_rounded(e)} AS {n}' for n, e in fields.items())} FROM {{epochs}}", epochs=epochs(spark, d))


@query(
    with_(SUP)
    + """SELECT chan::VARCHAR AS chan, i // 16 AS epoch, ROUND(AVG(x), 6) + 0.0 AS mean, ROUND(SUM(CASE WHEN i % 16 > 0 THEN (x + y) / 2 END), 6) + 0.0 AS area
FROM (SELECT *, LAG(x) OVER (PARTITION BY chan ORDER BY i) AS y FROM sup) GROUP BY 1, 2 HAVING COUNT(*) = 16"""
)
def sql_epochs(spark, d):
    """Epochs of 16 line prices by supplier from the table function, with SQL functions on them; suppliers are dealt to tasks.

    Means of 16 amounts in cents have six digits at most, so that rounding meets no ties."""
    sql.register(spark)
    rows = supplier_series(spark, d)
    cut = "sig_epochs(TABLE(SELECT chan AS key, i AS t, x FROM {rows}) PARTITION BY key ORDER BY (t), 16)"
    return spark.sql(f"SELECT key AS chan, epoch, round(sig_mean(x), 6) + 0D AS mean, round(sig_trapezoid(x), 6) + 0D AS area FROM {cut}", rows=rows)
