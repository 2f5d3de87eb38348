"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing of the documents table.

Each stage takes what its predecessor kept, as written to Parquet and read again; all but the last return the
columns of documents. A row is told by its id and the SHA-256 of its lower-cased text, so that rows of one id, or of
none, are rows of their own.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalspark.llm import language_id, lsm_dedup, mixing, packing, simhash
from signalspark.llm.common import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_sha(docs: DataFrame) -> DataFrame:
    """Rows with ``sha``, as ``lsm_dedup`` takes it: of the text's bytes with A-Z lower-cased, null as empty."""
    names = [*COLUMNS, "sha"]

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hashlib.sha256(t.lower() if t else b"").digest() for t in texts], pa.binary())], names)

    rows = docs.select(COLUMNS)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, sha binary")


def _same_row(rows: DataFrame, other: DataFrame):
    """Whether a row is the one that (of_id, of_sha) of ``other`` names."""
    return rows["doc_id"].eqNullSafe(other["of_id"]) & (rows["sha"] == other["of_sha"])


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row per (doc_id, sha): of repeated rows, and of texts that differ in case only, the least text and source."""
    same = Window.partitionBy(F.coalesce("doc_id", F.lit(0).cast("long")), F.isnull("doc_id"), "sha")
    nth = F.row_number().over(same.orderBy("text", "source", "lang", "n_chars"))
    return rows.withColumn("copy", nth).where("copy = 1").select(COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without letters, or without a likely language, go.

    Null, empty and wordless texts have no language and go; long texts are judged whole. Rows are judged by themselves, so
    repeated rows and ties of ids stay or go alike. Further columns are dropped; no rows give no rows."""
    model = language_id.fit(docs, learn=~language_id.held_out())
    return language_id.predict(docs, model, spread=["doc_id"], seen=True).where("lang_pred <> 'und' and score >= 0.5").select(COLUMNS)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal ones, once; a null id only if none has another.

    Texts are equal by their bytes after lower-casing A-Z, null as empty. Of rows with that id and text one stays, the
    least text. Long texts are compared whole. Further columns are dropped; no rows give no rows."""
    kept = lsm_dedup.exact_duplicates(docs, keep="largest").where("kept").select(F.col("doc_id").alias("of_id"), F.unhex("sha").alias("of_sha"))
    rows = _with_sha(docs)
    return _one_of_each(rows.join(kept, _same_row(rows, kept), "left_semi"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component, null last; of one id, that of the least sha.

    Repeated rows are one document and stay once. Null and wordless texts have the fingerprint zero and are one
    component. Long texts are read whole. Further columns are dropped; no rows give no rows."""
    rows = _with_sha(docs)
    found = simhash.near_duplicates(rows, carry=["sha"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("least")
    stays = found.groupBy("root").agg(least).select(F.col("least.doc_id").alias("of_id"), F.col("least.sha").alias("of_sha"))
    return _one_of_each(rows.join(stays, _same_row(rows, stays), "left_semi"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; sources weigh 5, 2, 1 in turn, null last.

    Texts without words are never taken. Rows of one id, text and source share what the mix takes of them, so repeated rows come
    no more often than it says. Long texts are taken whole or not at all. Further columns are dropped; no rows give none."""
    rows = _with_sha(docs)
    taken = mixing.mix(rows, whole_documents=True, carry=["sha"]).where("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("of_id"), F.col("sha").alias("of_sha"), F.col("source").alias("of_source"))
    taken = taken.agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("copies"))
    rows = rows.join(taken, _same_row(rows, taken) & rows["source"].eqNullSafe(taken["of_source"]))
    same = Window.partitionBy(F.coalesce("doc_id", F.lit(0).cast("long")), F.isnull("doc_id"), "sha", F.coalesce("source", F.lit("")), F.isnull("source"))
    # The group's copies are dealt to its rows in turn.
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy("text", "lang", "n_chars"))).withColumn("twins", F.count("*").over(same))
    times = F.expr("copies div twins + if(nth <= copies % twins, 1, 0)").cast("int")
    return rows.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 4096 words.

    Longer texts are cut into pieces; null and wordless ones have none. Equal texts are kept apart. Repeated rows are packed
    each. No rows give no rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL cannot express SimHash components or best-fit packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = f"{shared}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
