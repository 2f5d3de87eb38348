"""Time joins: as-of, bucketed range, interpolation; duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str], forward: bool = False) -> DataFrame:
    """Left rows with ``columns`` of the last right row at or before them (or the first at or after).

    One sort-based pass: both sides are stacked and the nearest value is carried along a window, so no pair
    beyond the result is made. Rows of equal time match; among equal right rows the one with the larger
    ``columns`` wins. Left rows without a match get nulls."""
    side = F.lit(1 if forward else 0)
    keep = [c for c in left.columns if c not in (*by, on)]
    taken = F.struct(*(F.col(c).alias(c) for c in columns))
    r = right.select(*by, on, side.alias("side"), F.lit(None).cast("struct<>" if not keep else left.select(F.struct(*keep).alias("s")).schema[0].dataType).alias("mine"), taken.alias("taken"))
    m = F.struct(*(F.col(c).alias(c) for c in keep))
    lf = left.select(*by, on, (F.lit(1) - side).alias("side"), m.alias("mine"), F.lit(None).cast(r.schema["taken"].dataType).alias("taken"))
    w = Window.partitionBy(*by).orderBy(on, "side", "taken") if by else Window.orderBy(on, "side", "taken")
    if forward:
        value = F.first("taken", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        value = F.last("taken", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = lf.unionByName(r).withColumn("value", value).where(F.col("side") == (0 if forward else 1))
    return out.select(*by, on, *(F.col(f"mine.{c}").alias(c) for c in keep), *(F.col(f"value.{c}").alias(c) for c in columns))


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, stop: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points inside [start, stop], an equi-join on buckets of ``width``: each range is listed in the buckets it
    touches, so only points near it are compared. ``width`` should be about the usual length of a range."""
    by = by or []
    p = points.withColumn("bucket", F.floor(F.col(at) / width))
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return p.join(r, [*by, "bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))).drop("bucket")


def interpolate_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str) -> DataFrame:
    """Left rows with ``value`` of the right side interpolated at their time; null outside its range."""
    before = asof_join(left, right.withColumn("t0", F.col(on)).withColumn("v0", F.col(value)).drop(value), on, by, ["t0", "v0"])
    both = asof_join(before, right.withColumn("t1", F.col(on)).withColumn("v1", F.col(value)).drop(value), on, by, ["t1", "v1"], forward=True)
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(on) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return both.withColumn(value, F.when(F.col("t0") == F.col("t1"), F.col("v0")).otherwise(line)).drop("t0", "v0", "t1", "v1")


def drop_all_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; every row of a repeated key goes."""
    once = df.groupBy(*keys).count().where("count = 1").drop("count")
    return df.join(once, keys, "left_semi")
