"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names; a folder of its own only in local mode, where all share one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut`` but as compressed Parquet in the same folder, for larger tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with a ``table`` of one row per key, which comes ``salts`` times so that the rows of one key are
    dealt to as many tasks by the columns ``spread``."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "salt"], how).drop("salt")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in; the rest is translated letter by letter."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def most_frequent(df: DataFrame, n: Column, limit: int) -> DataFrame:
    """The rows with the largest ``n`` (> 0), at most ``limit`` of them.

    Rows are ranked by sixteenths of an octave of n and a level that would pass the limit is left out with all
    below it, so equal counts are treated alike and only a histogram of a few hundred rows is gathered."""
    level = F.floor(F.log2(n) * 16)
    seen = df.groupBy(level.alias("level")).count()
    above = F.sum("count").over(Window.orderBy(F.desc("level")))
    least = seen.withColumn("above", above).where(F.col("above") <= limit).agg(F.min("level")).first()[0]
    return df.where(level >= (F.lit(None) if least is None else F.lit(least)))


def slot_filter(df: DataFrame, hashed: Column, bits: int = 26) -> np.ndarray:
    """Bit set of the top ``bits`` bits of a 64-bit hash: 8 MB at 26, whatever the number of rows.

    Bit i of byte j stands for slot 8 j + i. A slot that is not set proves that a row is absent from ``df``."""
    slot = F.shiftrightunsigned(hashed, 64 - bits)
    maps = df.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("part"))
    maps = maps.agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out
