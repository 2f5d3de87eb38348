"""Queries that need array kernels or pyspark.ml; checked by tests, not by SQL, but for sample entropy and Welch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from signalspark.functions import kernels as k
from signalspark.functions.arrays import rnd
from signalspark.plans.catalog_epochs import PSD, ROUND_SQL
from signalspark.plans.features import generate_features
from signalspark.plans.inputs import SIG, SRATE, N, epochs, with_
from signalspark.plans.registry import ORACLES, query
from signalspark.schema import BANDS, FURTHER, FeatureSpec


def _rounded(df, keys, names, digits=6):
    return df.select(*keys, *(rnd(F.col(n), digits).alias(n) for n in names))


NONLINEAR = {"perm_entropy": ("pe", "PermEntropy"), "svd_entropy": ("svd", "SVDEntropy"), "petrosian_fd": ("fd", "PetrosianFD"), "katz_fd": ("fd", "KatzFD"), "higuchi_fd": ("fd", "HiguchiFD"), "plzc": ("plzc", "PLZC")}


def _table_sql() -> str:
    """The feature table as a join of the SQL of its families."""
    bands = ", ".join(f"MAX(power) FILTER (band = '{n}') AS \"{n}_PSD\"" for _, _, n in BANDS)
    edge = "SELECT vec_id, MIN(k - 1)::BIGINT AS \"SpectralEdge\" FROM (SELECT vec_id, k, SUM(p) OVER (PARTITION BY vec_id ORDER BY k) AS c, SUM(p) OVER (PARTITION BY vec_id) AS t FROM psd WHERE k BETWEEN 1 AND 32) WHERE c >= 0.5 * t GROUP BY 1"
    points = "pts0 AS (SELECT vec_id, LOG10(k) AS f, CASE WHEN p <= 1e-20 THEN -20 ELSE LOG10(p) END AS p FROM psd WHERE k BETWEEN 1 AND 31)"
    line = 'SELECT vec_id, ROUND(regr_intercept(p, f), 6) + 0.0 AS "Offset", ROUND(-regr_slope(p, f), 6) + 0.0 AS "Exponent", ROUND(regr_r2(p, f), 6) + 0.0 AS "FitR2" FROM pts2 GROUP BY 1'
    parts = [
        f"SELECT vec_id, {bands} FROM ({ORACLES['bandpower_relative']}) GROUP BY 1",
        f"SELECT vec_id, total AS \"TotalAbsPow\" FROM ({ORACLES['total_power_log']})",
        with_(PSD) + edge,
        with_(PSD, points, ROUND_SQL.format(n=1, m=0), ROUND_SQL.format(n=2, m=1)) + line,
        *(f'SELECT vec_id, {c} AS "{new}" FROM ({ORACLES[q]})' for q, (c, new) in NONLINEAR.items()),
        f"SELECT vec_id, acw AS \"ACW\" FROM ({ORACLES['acw']})",
        f"SELECT vec_id, activity AS \"Activity\", mobility AS \"Mobility\", complexity AS \"Complexity\" FROM ({ORACLES['hjorth']})",
    ]
    return "SELECT * FROM (SELECT vec_id, label FROM embeddings) " + " ".join(f"JOIN ({p}) AS part{i} USING (vec_id)" for i, p in enumerate(parts))


def _table(df):
    return df.select(*(F.col(c) if c in ("vec_id", "label") else F.col(c).cast("long").alias(c) if c == "SpectralEdge" else rnd(F.col(c)).alias(c) for c in df.columns))


@query(_table_sql())
def feature_table(spark, d):
    """The flagship: spectral, aperiodic, complexity and time features per epoch."""
    return _table(generate_features(epochs(spark, d), ["vec_id", "label"], SRATE, N))


@query()
def feature_table_further(spark, d):
    """Sample entropy, Lempel-Ziv, fluctuation, parameterised and resampled spectra, canonical characteristics."""
    return _table(generate_features(epochs(spark, d), ["vec_id", "label"], SRATE, N, FeatureSpec(families=FURTHER)))


@query(with_(PSD) + "SELECT vec_id, k::BIGINT AS k, ROUND(p, 6) + 0.0 AS p FROM psd")
def welch_bandpower(spark, d):
    """Welch spectra by the kernel; one segment per epoch here, so the direct transform must give the same."""
    out = k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"p": k.welch(x, SRATE, N)[1]}, "p array<double>")
    return out.select("vec_id", F.posexplode("p").alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), rnd(F.col("p")).alias("p"))


@query(
    with_(SIG)
    + """, s AS (SELECT vec_id, 0.2 * STDDEV_POP(x) AS r FROM sig GROUP BY 1),
e AS (SELECT vec_id, i, x, LEAD(x) OVER w AS y, LEAD(x, 2) OVER w AS z FROM sig WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
m AS (SELECT a.vec_id, COUNT(*) AS b, SUM((ABS(a.z - b.z) < r)::INT) AS a FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i JOIN s ON s.vec_id = a.vec_id
  WHERE b.i < 62 AND ABS(a.x - b.x) < r AND ABS(a.y - b.y) < r GROUP BY 1)
SELECT s.vec_id, ROUND(CASE WHEN b IS NULL THEN 0 WHEN a > 0 THEN -LN(a / b) END, 6) + 0.0 AS sampen FROM s LEFT JOIN m USING (vec_id)"""
)
def sample_entropy(spark, d):
    out = k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"sampen": k.sample_entropy(x)}, "sampen double")
    return _rounded(out, ["vec_id"], ["sampen"])


@query(
    "WITH RECURSIVE "
    + SIG
    + """, bits AS (SELECT vec_id, STRING_AGG(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY i) AS s FROM (SELECT *, AVG(x) OVER (PARTITION BY vec_id) AS m FROM sig) GROUP BY 1),
lz(vec_id, s, pos, size, c) AS (SELECT vec_id, s, 0, 1, 0 FROM bits UNION ALL
  SELECT vec_id, s, CASE WHEN longer THEN pos ELSE pos + size END, CASE WHEN longer THEN size + 1 ELSE 1 END, CASE WHEN longer THEN c ELSE c + 1 END
  FROM (SELECT *, pos + size <= 64 AND CONTAINS(SUBSTR(s, 1, pos + size - 1), SUBSTR(s, pos + 1, size)) AS longer FROM lz WHERE pos < 64))
SELECT vec_id, ROUND(MAX(c) * LOG2(64) / 64, 6) + 0.0 AS lz FROM lz GROUP BY 1"""
)
def lz76(spark, d):
    """Lempel-Ziv complexity of the epochs above their mean."""
    out = k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"lz": k.lempel_ziv_normalised(x)}, "lz double")
    return _rounded(out, ["vec_id"], ["lz"])


@query()
def irasa(spark, d):
    """Aperiodic and oscillatory parts by irregular resampling."""
    names = ["offset", "slope", "r2", "osc_area", "osc_std"]
    out = k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: k.irasa(x, SRATE, 32, 2.0, 20.0), ", ".join(f"{n} double" for n in names))
    return _rounded(out, ["vec_id"], names)


@query()
def parameterised_spectra(spark, d):
    """Line and two peaks of each spectrum."""
    names = ["offset", "exponent", "error", "r2", "cf_0", "pw_0", "bw_0", "cf_1", "pw_1", "bw_1"]

    def kernel(x):
        f, p = k.welch(x, SRATE, N)
        keep = (f >= 1) & (f <= 30)
        return k.peaks_and_slope(p[:, keep], f[keep])

    return _rounded(k.map_epochs(epochs(spark, d), ["vec_id"], kernel, ", ".join(f"{n} double" for n in names)), ["vec_id"], names)


@query()
def band_envelopes(spark, d):
    """Mean and peak of the power envelope of the alpha band."""

    def kernel(x):
        e = k.envelope(x, SRATE, 8.0, 12.0)
        return {"mean": e.mean(axis=1), "peak": e.max(axis=1)}

    return _rounded(k.map_epochs(epochs(spark, d), ["vec_id"], kernel, "mean double, peak double"), ["vec_id"], ["mean", "peak"])


@query()
def phase_amplitude_coupling(spark, d):
    out = k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"pac": k.phase_amplitude(x, SRATE, (4, 8), (16, 28))}, "pac double")
    return _rounded(out, ["vec_id"], ["pac"])


@query()
def canonical_characteristics(spark, d):
    names = ["mode_5", "mode_10", "acf_timescale", "acf_first_min", "trev", "high_fluctuation", "stretch_high", "stretch_decreasing", "forecast_error", "centroid_freq", "low_freq_power"]
    return _rounded(k.map_epochs(epochs(spark, d), ["vec_id"], k.canonical_features, ", ".join(f"{n} double" for n in names)), ["vec_id"], names)


@query()
def mode_energies(spark, d):
    """Energies of the modes found by sifting."""
    out = k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"energy": np.array([k.sift(v) for v in x])}, "energy array<double>")
    return out.select("vec_id", F.posexplode("energy").alias("mode", "energy")).select("vec_id", "mode", rnd(F.col("energy")).alias("energy"))


@query()
def principal_components(spark, d):
    """Scores on four principal components, fitted by pyspark.ml from a distributed Gram matrix."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = epochs(spark, d).select("vec_id", array_to_vector("x").alias("v"))
    out = PCA(k=4, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", *(rnd(F.abs(F.col("p")[i])).alias(f"pc{i}") for i in range(4)))


@query()
def microstate_clusters(spark, d):
    """KMeans with six clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = epochs(spark, d).select("vec_id", array_to_vector("x").alias("features"))
    return KMeans(k=6, seed=42, maxIter=10).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def class_probabilities(spark, d):
    """Random forest on principal components: the most likely class of each epoch and its probability."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = epochs(spark, d).select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("v"))
    model = Pipeline(stages=[PCA(k=6, inputCol="v", outputCol="features"), RandomForestClassifier(numTrees=20, maxDepth=5, seed=42)]).fit(rows)
    p = F.array_max(vector_to_array("probability"))
    return model.transform(rows).select("vec_id", F.col("prediction").cast("int").alias("prediction"), rnd(p).alias("probability"))


@query()
def wavelet_power(spark, d):
    """Morlet power at six frequencies."""
    freqs = [4.0, 6.0, 8.0, 12.0, 16.0, 24.0]
    out = k.map_epochs(epochs(spark, d), ["vec_id"], lambda x: {"p": k.morlet_power(x, SRATE, freqs)}, "p array<double>")
    return out.select("vec_id", *(rnd(F.col("p")[i]).alias(f"p{int(f)}") for i, f in enumerate(freqs)))


@query()
def beat_detection(spark, d):
    """Peaks of each epoch by the R-peak detector, and the mean distance between them."""

    def kernel(x):
        found = k.r_peaks(x, SRATE)
        return {"n": np.array([len(f) for f in found], float), "rr": np.array([np.diff(f).mean() / SRATE if len(f) > 1 else np.nan for f in found])}

    return _rounded(k.map_epochs(epochs(spark, d), ["vec_id"], kernel, "n double, rr double"), ["vec_id"], ["n", "rr"])


@query()
def directed_compression(spark, d):
    """Compression causality between the halves of each epoch, both ways."""

    def kernel(x):
        h = x.shape[1] // 2
        return {"forth": np.array([k.compression_causality(v[:h], v[h:]) for v in x]), "back": np.array([k.compression_causality(v[h:], v[:h]) for v in x])}

    return _rounded(k.map_epochs(epochs(spark, d), ["vec_id"], kernel, "forth double, back double"), ["vec_id"], ["forth", "back"])
