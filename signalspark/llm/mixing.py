"""Mixing sources to target weights by prefix sums over hash-random keys.

Every row gets a random key (the MD5 of its id and a seed). Equal ranges of the key cut each source into
buckets of a few thousand rows, so a source that holds a third of all rows is spread like the others. Bucket
sums give each bucket its place in the source's prefix sum, a window inside the bucket gives each row its own,
and the row's place against the source's budget says how often it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> also target: shares of the sum of all sizes by weight, none above max_epochs sizes.

    Weights go round the sources in code-point order, null last. One row per source. With level L, a target is
    the lesser of L x weight and the limit; sources ordered by limit / weight are limited up to the first one
    whose L, from what the limited ones leave, does not exceed its own limit / weight."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("double")
    limit = (F.col("source_size") * max_epochs).cast("double")
    s = sizes.withColumn("rank", order).withColumn("weight", w).withColumn("limit", limit)
    everything = Window.partitionBy()
    turn = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("limited", F.sum("limit").over(turn) - F.col("limit"))
    s = s.withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(turn) + F.col("weight"))
    s = s.withColumn("level", (F.col("total") - F.col("limited")) / F.col("open"))
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("fits"), F.col("limit") / F.col("weight"))).over(everything))
    return s.select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
    whole_documents: bool = False,
    bucket_rows: int = 4096,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per input row: (doc_id, source, size, source_size, target, taken).

    taken is the number of words that the mix uses, epochs counted; a source's taken words add up to its target
    rounded to a word, as the last epoch stops inside the document where the budget ends. With
    ``whole_documents`` that document is used whole if at least half of it lies within the budget. Null texts
    have size 0 and are never taken; null sources form a source of their own, last in order. Rows with equal
    ids follow each other by size; equal rows share one place in any order. Columns to ``carry`` tell rows of one id apart and come
    last. No rows: no result rows."""
    carry = carry or []
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *carry))
    bits = max(0, min(16, (max(1, sized.count()) // bucket_rows).bit_length()))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    keyed = sized.withColumn("key", key)
    keyed = keyed.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - bits))
    sums = cut(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    starts = sums.withColumn("start", F.sum("bucket_size").over(by_bucket) - F.col("bucket_size"))
    t = targets.withColumnRenamed("source", "of")
    starts = starts.join(t, starts["source"].eqNullSafe(t["of"])).select(F.col("source").alias("of"), F.col("bucket").alias("place"), "start", "source_size", "target")
    rows = keyed.join(starts, keyed["source"].eqNullSafe(starts["of"]) & (keyed["bucket"] == starts["place"]))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rest = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    if whole_documents:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), *carry)


#: op2 for DuckDB.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (source_size * 3)::DOUBLE AS lim FROM r),
o AS (SELECT *, (SUM(source_size) OVER ())::DOUBLE AS total, SUM(lim) OVER t - lim AS limited,
        SUM(weight) OVER () - SUM(weight) OVER t + weight AS open
      FROM w WINDOW t AS (ORDER BY lim / weight, rank)),
l AS (SELECT *, (total - limited) / open AS level FROM o),
m AS (SELECT MIN_BY(level, lim / weight) AS level FROM l WHERE level * weight <= lim),
g AS (SELECT source, source_size, LEAST(lim, m.level * weight) AS target FROM l, m),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target,
        SUM(d.size) OVER (PARTITION BY d.source ORDER BY md5(COALESCE(d.doc_id::VARCHAR, 'null') || ':mix'), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
        CASE WHEN g.source_size > 0 THEN FLOOR(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs
      FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + GREATEST(0, LEAST(size, ROUND(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM c
"""
