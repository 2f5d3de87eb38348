"""Statistics: comparisons of correlations, resampling, encodings, sequence features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.operators.lineage import cut

Z95 = 1.959963984540054


def fisher_interval(r: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Confidence limits of a correlation."""
    half = z / F.sqrt(n - 3)
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def steiger_t(xy: Column, xz: Column, yz: Column, n: Column) -> Column:
    """t with n - 3 degrees of freedom for two correlations that share a variable."""
    det = 1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz
    mean = (xy + xz) / 2
    below = 2 * (n - 1) / (n - 3) * det + mean * mean * F.pow(1 - yz, F.lit(3))
    return (xy - xz) * F.sqrt((n - 1) * (1 + yz) / below)


def fisher_z(xy: Column, ab: Column, n: Column, n2: Column) -> Column:
    """z for two independent correlations."""
    return F.abs(F.atanh(xy) - F.atanh(ab)) / F.sqrt(1 / (n - 3) + 1 / (n2 - 3))


def zou_dependent(xy: Column, xz: Column, yz: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of xy - xz by Zou's method."""
    l1, u1 = fisher_interval(xy, n, z)
    l2, u2 = fisher_interval(xz, n, z)
    c = ((yz - 0.5 * xy * xz) * (1 - xy * xy - xz * xz - yz * yz) + yz * yz * yz) / ((1 - xy * xy) * (1 - xz * xz))
    low = xy - xz - F.sqrt((xy - l1) ** 2 + (u2 - xz) ** 2 - 2 * c * (xy - l1) * (u2 - xz))
    high = xy - xz + F.sqrt((u1 - xy) ** 2 + (xz - l2) ** 2 - 2 * c * (u1 - xy) * (xz - l2))
    return low, high


def zou_independent(xy: Column, ab: Column, n: Column, n2: Column, z: float = Z95) -> tuple[Column, Column]:
    l1, u1 = fisher_interval(xy, n, z)
    l2, u2 = fisher_interval(ab, n2, z)
    return xy - ab - F.sqrt((xy - l1) ** 2 + (u2 - ab) ** 2), xy - ab + F.sqrt((u1 - xy) ** 2 + (ab - l2) ** 2)


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal: Abramowitz and Stegun 7.1.26 for erfc, error below 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def student_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t for a whole number of degrees of freedom, by its finite series in the angle
    atan(t / sqrt(dof)); null below one degree."""
    nu = dof.cast("int")
    c = F.sqrt(nu / (nu + t * t))
    s = F.abs(t) / F.sqrt(nu + t * t)
    odd = nu % 2
    terms = F.greatest(F.lit(0), F.floor((nu - 2 - odd) / 2).cast("int"))

    def longer(a: Column, k: Column) -> Column:
        # Even: (2k - 1) / 2k, odd: 2k / (2k + 1); each step also takes the square of the cosine.
        term = a["term"] * c * c * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    first = F.when(odd == 1, c).otherwise(F.lit(1.0))
    steps = F.filter(F.sequence(F.lit(0), terms), lambda k: k > 0)
    series = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), longer)["sum"]
    angle = F.atan2(F.abs(t), F.sqrt(nu.cast("double")))
    inner = F.when(odd == 0, s * series).when(nu == 1, 2 / math.pi * angle).otherwise(2 / math.pi * (angle + s * series))
    return F.when(nu >= 1, F.greatest(F.lit(0.0), 1 - inner))


# The published coefficients of Acklam's rational approximation of the normal quantile.
QUANTILE_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
QUANTILE_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal, relative error below 1.2e-9; null outside (0, 1)."""

    def poly(factors: list[float], x: Column) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * x + f
        return out

    def tail(x: Column) -> Column:
        q = F.sqrt(-2 * F.ln(x))
        return poly(QUANTILE_C, q) / poly(QUANTILE_D, q)

    q = p - 0.5
    middle = q * poly(QUANTILE_A, q * q) / poly(QUANTILE_B, q * q)
    inner = F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)
    return F.when((p > 0) & (p < 1), inner)


def label_encode(df: DataFrame, value: str, out: str = "code") -> DataFrame:
    """Codes 0 .. k-1 in the order of the values, null for null.

    The distinct values are ranked, not the rows: each of their ranges by itself, behind the values of the ranges before, so
    no task holds all of them."""
    values = df.select(F.col(value).alias("value of")).where(F.col(value).isNotNull()).distinct()
    parts = cut(values.repartitionByRange("value of").withColumn("part of", F.spark_partition_id()))
    counts = parts.groupBy("part of").agg(F.count("*").alias("n of"))
    before = Window.orderBy("part of").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("part of", F.coalesce(F.sum("n of").over(before), F.lit(0)).alias("start of"))
    inside = F.row_number().over(Window.partitionBy("part of").orderBy("value of")) - 1
    codes = parts.withColumn("place of", inside).join(starts, "part of").select("value of", (F.col("place of") + F.col("start of")).cast("int").alias(out))
    return df.join(codes, df[value] == codes["value of"], "left").drop("value of")


def pure_windows(df: DataFrame, keys: list[str], order: str, label: str, size: int) -> DataFrame:
    """Rows that end a window of ``size`` rows with one label."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    df = df.withColumn("seen", F.count(label).over(w)).withColumn("least", F.min(label).over(w)).withColumn("most", F.max(label).over(w))
    return df.where((F.col("seen") == size) & (F.col("least") == F.col("most"))).drop("seen", "least", "most")


def sequence_graph(df: DataFrame, keys: list[str], order: str, symbol: str, kappa: float) -> DataFrame:
    """(keys, u, v, weight, n): sequence graph transform, (mean of exp(-kappa gap))**(1/kappa) over all n pairs of u before v.

    Pairs are counted by running counts of each symbol, events times symbols rows. The decayed sums run inside blocks of
    300 / kappa events, where exp(kappa place) stays in range; a block hands on one decayed sum per symbol, which the two blocks
    behind it add (further ones are below what a double can hold). So every pair counts, however far apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    size = max(1, int(300 / kappa))
    place = F.row_number().over(w) - 1
    rows = df.select(*keys, order, F.col(symbol).alias("v"), F.floor(place / size).alias("c"), (place % size).alias("o"))
    first = rows.groupBy(*keys, F.col("v").alias("u")).agg(F.count("*").alias("of u"))
    grown, decayed = F.exp(F.lit(kappa) * F.col("o")), F.exp(F.lit(-kappa) * F.col("o"))
    is_u = F.col("v") == F.col("u")

    def before(*by: str) -> Window:
        return Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    pairs = rows.join(first, keys).withColumn("count of u", F.coalesce(F.sum(is_u.cast("long")).over(before("u")), F.lit(0)))
    pairs = pairs.withColumn("near", decayed * F.coalesce(F.sum(F.when(is_u, grown)).over(before("u", "c")), F.lit(0.0)))
    pairs = pairs.groupBy(*keys, "u", "v").agg(F.sum("count of u").alias("n"), F.sum("near").alias("near")).where("n > 0")
    blocks = rows.groupBy(*keys, "c", "v").agg(F.sum(grown).alias("up"), F.sum(decayed).alias("down"))
    behind = F.explode(F.array(*(F.struct((F.col("c") + d).alias("c"), (F.col("up") * math.exp(-kappa * size * d)).alias("carry")) for d in (1, 2))))
    carried = blocks.select(*keys, F.col("v").alias("u"), behind.alias("b")).select(*keys, "u", "b.*").groupBy(*keys, "u", "c").agg(F.sum("carry").alias("carry"))
    far = carried.join(blocks, [*keys, "c"]).groupBy(*keys, "u", "v").agg(F.sum(F.col("carry") * F.col("down")).alias("far"))
    total = F.col("near") + F.coalesce("far", F.lit(0.0))
    weight = F.pow(total / F.col("n"), F.lit(1 / kappa))
    return pairs.join(far, [*keys, "u", "v"], "left").select(*keys, "u", "v", weight.alias("weight"), "n")


def quantile_rank(df: DataFrame, keys: list[str], value: str, out: str = "q") -> DataFrame:
    """Rank in (0, 1) within the key: (percent rank x (n - 1) + 0.5) / n."""
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(value)) - 1
    return df.withColumn(out, (rank + 0.5) / F.count(value).over(w))


def bootstrap_means(df: DataFrame, keys: list[str], item: str, value: str, draws: int) -> DataFrame:
    """(keys, draw, mean): means of resamples in which each item counts Poisson(1) times.

    The counts come from a hash of (item, draw), so a rerun gives the same draws and nothing is collected: one
    partial aggregate over items x draws."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(item).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    steps, p, c = [], math.exp(-1), 0.0
    for k in range(8):
        c += p
        steps.append((c, k))
        p /= k + 1
    times = F.lit(8)
    for limit, k in reversed(steps):
        times = F.when(F.col("u") < limit, k).otherwise(times)
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("u", u).withColumn("times", times)
    return rows.groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col(value) * F.col("times")), F.sum("times")).alias("mean"))


def entropy_of(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, entropy): base-2 entropy of the categories' shares."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    # sum(-p log p) = log N - sum(n log n) / N, so one more aggregate does.
    return counts.groupBy(*keys).agg((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("entropy"))
