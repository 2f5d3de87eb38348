"""Running sums and windows of neighbours over series of any length, in two levels.

A series is cut into stretches of its order. Each stretch is summed up, the sums (one row a stretch) are carried along the
series, and each stretch starts from what is carried to it; so one channel runs on as many tasks as it has stretches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16


def running_sum(df: DataFrame, keys: list[str], column: Column, out: str, order: str, size: int = STRETCH) -> DataFrame:
    """Rows with the sum of ``column`` up to and including each, by a numeric ``order``; nulls count nothing, and the sum is null before
    the first value. Rows without an order come first. ``size``: length of a stretch, in units of the order.

    The carried sum enters a stretch as a row before its first, so no join is needed."""
    rows = df.withColumn("_stretch", F.floor(F.col(order) / size)).withColumn("_part", column).withColumn("_own", F.lit(True))
    along = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum("_part").alias("_sum"))
    carried = sums.select(*keys, "_stretch", F.sum("_sum").over(along).alias("_part"), F.lit(False).alias("_own")).where("_part is not null")
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_own", order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(carried, allowMissingColumns=True)
    return both.withColumn(out, F.sum("_part").over(inside)).where("_own").drop("_stretch", "_part", "_own")


def by_pieces(df: DataFrame, keys: list[str], order: str, before: int, after: int, apply: Callable[[DataFrame, list[str], str], DataFrame], size: int = STRETCH, span: int = STRETCH) -> DataFrame:
    """``apply(rows, keys of a piece, order)`` for windows that look at most ``before`` rows back and ``after`` rows ahead.

    Rows are numbered along the series and cut into pieces of ``size`` rows; a piece has its neighbours' rows next to it
    too, which are dropped afterwards. ``apply`` must keep the columns ``_row`` and ``_piece``. ``span``: stretch of the order
    in which rows are numbered."""
    size = max(size, before, after)
    rows = running_sum(df, keys, F.lit(1), "_row", order, span).withColumn("_row", F.col("_row") - 1)
    own, place = F.floor(F.col("_row") / size), F.col("_row") % size
    near = F.array_compact(F.array(own, F.when(place >= size - before, own + 1), F.when(place < after, own - 1)))
    done = apply(rows.withColumn("_piece", F.explode(near)), [*keys, "_piece"], "_row")
    return done.where(own == F.col("_piece")).drop("_row", "_piece")


def nearest(df: DataFrame, keys: list[str], column: Column, out: str, order: str, ahead: bool = False, own: bool = True, size: int = STRETCH) -> DataFrame:
    """Rows with the last value of ``column`` that is not null, at or before each; ``ahead``: the first one at or after it.

    Without ``own`` the row's own value doesn't count. Null where there is none. ``order`` is numeric and not null."""
    rows = df.withColumn("_stretch", F.floor(F.col(order) / size)).withColumn("_part", column).withColumn("_side", F.lit(1))
    along = Window.partitionBy(*keys).orderBy("_stretch")
    at = F.when(F.col("_part").isNotNull(), F.col(order))
    ends = rows.groupBy(*keys, "_stretch").agg((F.min_by("_part", at) if ahead else F.max_by("_part", at)).alias("_end"))
    if ahead:
        come = F.first("_end", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    else:
        come = F.last("_end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*keys, "_stretch", come.alias("_part"), F.lit(2 if ahead else 0).alias("_side")).where("_part is not null")
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_side", order)
    if ahead:
        found = F.first("_part", ignorenulls=True).over(inside.rowsBetween(0 if own else 1, Window.unboundedFollowing))
    else:
        found = F.last("_part", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    return rows.unionByName(carried, allowMissingColumns=True).withColumn(out, found).where("_side = 1").drop("_stretch", "_part", "_side")
