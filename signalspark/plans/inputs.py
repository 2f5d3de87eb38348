"""Signals made of the test tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SRATE = 64.0
N = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x): epochs of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, i, x)."""
    return epochs(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("i", "x"))


SIG = "sig AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, UNNEST(embedding)::DOUBLE AS x FROM embeddings)"


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chan, i, x): line prices of each supplier in order of shipping."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.select(F.col("l_suppkey").alias("chan"), (F.row_number().over(order) - 1).alias("i"), F.col("l_extendedprice").alias("x"))


SUP = "sup AS (SELECT l_suppkey AS chan, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i, l_extendedprice AS x FROM lineitem)"


def seconds(c: str):
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"cast(cast({c} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6))").cast("double")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, chan, t, x): irregular samples by type of event, t in seconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("chan"), seconds("ts").alias("t"), F.col("value").alias("x"))


EVT = "evt AS (SELECT event_id, user_id, event_type AS chan, epoch_us(ts) / 1e6 AS t, value AS x FROM events)"


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chan, i, x): mean order price by priority and day, days counted from the first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("chan"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("day"), "o_totalprice")
    days = o.groupBy("chan", "day").agg(F.avg("o_totalprice").alias("x"))
    return days.select("chan", (F.row_number().over(Window.partitionBy("chan").orderBy("day")) - 1).alias("i"), "x")


DAY = """days AS (SELECT o_orderpriority AS chan, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day, AVG(o_totalprice) AS x FROM orders GROUP BY 1, 2),
day AS (SELECT chan, ROW_NUMBER() OVER (PARTITION BY chan ORDER BY day) - 1 AS i, x FROM days)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
