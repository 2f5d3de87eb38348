import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.functions import arrays, kernels, nonlinear, spectral, sql

H = [1.1, 1.3, 1.5, 1.7, 1.9]


@pytest.fixture(scope="module")
def epochs(spark):
    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=n).cumsum().tolist(), r.normal(size=n).tolist()) for k, n in enumerate([64, 64, 63, 32, 40])]
    rows.append((9, [2.5] * 32, [1.0] * 32))
    sql.register(spark)
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>").withColumn("p", F.transform("x", lambda v: v * v + 0.1))
    df.createOrReplaceTempView("sql_epochs_test")
    return df


PAIRS = {
    "sig_total(x)": lambda x, y, p: arrays.total(x),
    "sig_mean(x)": lambda x, y, p: arrays.mean(x),
    "sig_center(x)": lambda x, y, p: arrays.center(x),
    "sig_dot(x, y)": lambda x, y, p: arrays.dot(x, y),
    "sig_variance(x)": lambda x, y, p: arrays.variance(x),
    "sig_variance(x, 1)": lambda x, y, p: arrays.variance(x, 1),
    "sig_head(x, 3)": lambda x, y, p: arrays.head(x, 3),
    "sig_tail(x, 70)": lambda x, y, p: arrays.tail(x, 70),
    "sig_diff(x)": lambda x, y, p: arrays.diff(x),
    "sig_trapezoid(x, 0.5D)": lambda x, y, p: arrays.trapezoid(x, 0.5),
    "sig_simpson(x, 0.5D)": lambda x, y, p: arrays.simpson(x, 0.5),
    "sig_simpson(slice(x, 1, 2))": lambda x, y, p: arrays.simpson(F.slice(x, 1, 2)),
    "sig_simpson(slice(x, 1, 1))": lambda x, y, p: arrays.simpson(F.slice(x, 1, 1)),
    "sig_linear_fit(x, y)": lambda x, y, p: arrays.linear_fit(x, y),
    "sig_autocorrelation(x, 3)": lambda x, y, p: arrays.autocorrelation(x, F.lit(3)),
    "sig_interpolate(2.25D, x)": lambda x, y, p: arrays.interpolate(F.lit(2.25), x),
    "sig_interpolate(-1D, x)": lambda x, y, p: arrays.interpolate(F.lit(-1.0), x),
    "sig_interpolate(99D, x)": lambda x, y, p: arrays.interpolate(F.lit(99.0), x),
    "sig_periodogram(slice(x, 1, 32), 64D)": lambda x, y, p: spectral.periodogram(F.slice(x, 1, 32), 32, 64.0),
    "sig_periodogram(slice(x, 1, 31), 64D)": lambda x, y, p: spectral.periodogram(F.slice(x, 1, 31), 31, 64.0),
    "sig_crop(p, 0.5D, 1D, 9D)": lambda x, y, p: spectral.crop(p, 0.5, 1.0, 9.0),
    "sig_crop(p, 0.5D, 1D, 99D)": lambda x, y, p: spectral.crop(p, 0.5, 1.0, 99.0),
    "sig_band_power(p, 0.5D, 1D, 9D)": lambda x, y, p: spectral.band_power(p, 0.5, 1.0, 9.0),
    "sig_spectral_edge(p)": lambda x, y, p: spectral.spectral_edge(p),
    "sig_spectral_edge(p, 0.95D)": lambda x, y, p: spectral.spectral_edge(p, 0.95),
    "sig_log_fit(p, 0.5D, 1D, 15D)": lambda x, y, p: spectral.log_fit(p, 0.5, 1.0, 15.0),
    "sig_trimmed_log_fit(p, 0.5D, 1D, 15D)": lambda x, y, p: spectral.trimmed_log_fit(p, 0.5, 1.0, 15.0),
    "sig_irasa_lite(p, array(1.1D, 1.3D, 1.5D, 1.7D, 1.9D))": lambda x, y, p: spectral.irasa_lite(p, H),
    "sig_ordinal_codes(x)": lambda x, y, p: nonlinear.ordinal_codes(x),
    "sig_permutation_entropy(x)": lambda x, y, p: nonlinear.permutation_entropy(x),
    "sig_permutation_entropy(slice(x, 1, 2))": lambda x, y, p: nonlinear.permutation_entropy(F.slice(x, 1, 2)),
    "sig_pattern_complexity(x)": lambda x, y, p: nonlinear.pattern_complexity(x),
    "sig_coarse(x, 5)": lambda x, y, p: nonlinear.coarse(x, 5),
    "sig_petrosian_fd(x)": lambda x, y, p: nonlinear.petrosian_fd(x),
    "sig_katz_fd(x)": lambda x, y, p: nonlinear.katz_fd(x),
    "sig_higuchi_fd(y)": lambda x, y, p: nonlinear.higuchi_fd(y),
    "sig_higuchi_fd(x, 6)": lambda x, y, p: nonlinear.higuchi_fd(x, 6),
    "sig_acw(x, 64D)": lambda x, y, p: nonlinear.acw(x, 64.0),
    "sig_hjorth(x)": lambda x, y, p: nonlinear.hjorth(x),
}


def flat(v):
    if v is None:
        return [None]
    return [b for a in v for b in flat(a)] if isinstance(v, (list, tuple)) else [float(v)]


def test_sql_functions_equal_the_column_functions(spark, epochs):
    exprs = list(PAIRS)
    got = spark.sql(f"SELECT k, {', '.join(exprs)} FROM sql_epochs_test ORDER BY k").collect()
    want = epochs.orderBy("k").select("k", *(PAIRS[e](F.col("x"), F.col("y"), F.col("p")) for e in exprs)).collect()
    for g, w in zip(got, want, strict=True):
        for e, a, b in zip(exprs, g[1:], w[1:], strict=True):
            a, b = flat(a), flat(b)
            assert len(a) == len(b), (g["k"], e)
            assert all(u == v or (u is not None and v is not None and (abs(u - v) <= 1e-9 * max(1, abs(v)) or u != u and v != v)) for u, v in zip(a, b, strict=True)), (g["k"], e, a, b)


def test_sql_functions_have_no_python_and_no_shuffle(spark, epochs):
    names = [f"sig_{n}(x)" for n in ("hjorth", "katz_fd", "higuchi_fd", "permutation_entropy")]
    plan = spark.sql(f"SELECT {', '.join(names)} FROM sql_epochs_test")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_kernels_and_nulls(spark, epochs):
    rows = spark.sql("SELECT k, x, sig_sample_entropy(x) AS s, sig_lempel_ziv(x) AS z, sig_dfa(x) AS d FROM sql_epochs_test").collect()
    for r in rows:
        block = np.array([r["x"]])
        for name, kernel in (("s", kernels.sample_entropy), ("z", kernels.lempel_ziv_normalised), ("d", kernels.epoch_dfa)):
            want = kernel(block)[0]
            assert (r[name] is None and want != want) or abs(r[name] - want) < 1e-12
    none = spark.sql("SELECT sig_total(n) AS a, sig_hjorth(n).mobility AS b, sig_lempel_ziv(n) AS c, sig_dfa(array()) AS d FROM (SELECT CAST(NULL AS ARRAY<DOUBLE>) AS n)").first()
    assert tuple(none) == (None, None, None, None)


def test_table_function(spark, epochs):
    rows = [(k, t, float(t * 2 + len(k))) for k in ("a", "bb") for t in range(10)] + [(None, t, None) for t in range(4)] + [("short", 0, 1.0)]
    spark.createDataFrame(rows, "key string, t long, x double").repartition(3).createOrReplaceTempView("sql_rows_test")
    got = spark.sql("SELECT * FROM sig_epochs(TABLE(SELECT key, t, x FROM sql_rows_test) PARTITION BY key ORDER BY (t), 4)").collect()
    want = {(k, e, e * 4.0, tuple(float(t * 2 + len(k)) for t in range(e * 4, e * 4 + 4))) for k in ("a", "bb") for e in (0, 1)} | {(None, 0, 0.0, (None,) * 4)}
    assert {(r["key"], r["epoch"], r["start"], tuple(r["x"])) for r in got} == want and len(got) == len(want)
    assert spark.sql("SELECT * FROM sig_epochs(TABLE(SELECT key, t, x FROM sql_rows_test WHERE false) PARTITION BY key ORDER BY (t), 4)").isEmpty()


def test_prefix(spark):
    assert "eeg_mean" in sql.register(spark, "eeg_")
    assert spark.sql("SELECT eeg_mean(array(1D, 3D)) AS m").first()["m"] == 2.0
