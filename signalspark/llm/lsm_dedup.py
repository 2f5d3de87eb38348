"""Exact dedup over a log-structured merge index of text digests.

Memtables fill from the input and are flushed as sorted runs of (digest, first id, last id, count), written as
Parquet with a Bloom filter on the digest. Compaction merges sorted runs, each range of digests in one pass over its
entries in order, and keeps the smallest identifier and, beside it, the largest. A lookup consults the index's
filter, a bit set of bounded size over the digests asked for; what it rejects is settled, and only the rest is joined
with the entries. A lookup that hits is verified on bytes: the texts of groups with more than one row are compared
with the text of the row that stays; where a digest covers different texts, its rows are grouped by text instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm.common import cut, salted_join, shared_folder, slot_filter, store

SLOT_BITS = 26
RUN_SCHEMA = "run string, digest binary, first_id long, last_id long, n long"


class DigestIndex:
    """Runs lie under ``path`` in folders level=0 (as flushed) and level=1 (compacted)."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = 100_000):
        self.spark, self.memtable_rows = spark, memtable_rows
        self.path = path or f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}"
        self.flushed: list[str] = []
        self.compacted: str | None = None

    def _write(self, runs: DataFrame, level: int) -> str:
        to = f"{self.path}/level={level}/{uuid.uuid4().hex}"
        # Adaptive filters are an option of the file, not of a column; without them each file carries 1 MB.
        filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number#digest": "10"}
        runs.write.options(**filters).parquet(to)
        return to

    def add(self, rows: DataFrame) -> None:
        """Rows (doc_id, digest): each task fills memtables and flushes each as a sorted run."""
        limit = self.memtable_rows

        def flush(table: dict) -> pa.RecordBatch:
            return _run_batch(uuid.uuid4().hex, [(d, *table[d]) for d in sorted(table)])

        def run(batches: Iterator[pa.RecordBatch]):
            table: dict = {}
            for b in batches:
                for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    old = table.get(d)
                    table[d] = (i, i, 1) if old is None else (_least(old[0], i, min), _least(old[1], i, max), old[2] + 1)
                    if len(table) >= limit:
                        yield flush(table)
                        table = {}
            if table:
                yield flush(table)

        self.flushed.append(self._write(rows.select("doc_id", "digest").mapInArrow(run, RUN_SCHEMA), 0))

    def compact(self) -> None:
        """Merges the flushed runs with the compacted one."""
        runs = [*self.flushed, *([self.compacted] if self.compacted else [])]
        if not runs:
            return
        entries = self.spark.read.schema(RUN_SCHEMA).parquet(*runs).select("digest", "first_id", "last_id", "n")
        merged = entries.repartitionByRange("digest").sortWithinPartitions("digest").mapInArrow(_merge(uuid.uuid4().hex), RUN_SCHEMA)
        self.compacted, self.flushed = self._write(merged, 1), []

    def entries(self) -> DataFrame:
        """(digest, first_id, last_id, n), compacted first if runs were flushed since."""
        if self.flushed:
            self.compact()
        if not self.compacted:
            return self.spark.createDataFrame([], RUN_SCHEMA).drop("run")
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.compacted).drop("run")

    def lookup(self, rows: DataFrame, wanted: DataFrame, spread: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows with a ``digest`` -> (those that the filter over ``wanted``, entries of the index, rejects; the others, with
        the entry's columns or nulls). Rows of one digest are dealt to several tasks by the columns ``spread``."""
        seen = self.spark.sparkContext.broadcast(slot_filter(wanted, _head(), SLOT_BITS))
        size = len(rows.columns)

        def run(batches):
            for b in batches:
                slots = np.array([_slot(d) for d in b.column("digest").to_pylist()], np.int64)
                yield b.append_column("hit", pa.array(_filled(seen.value, slots)))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        marked = rows.mapInArrow(run, f"{kinds}, hit boolean")
        found = salted_join(marked.where("hit").drop("hit"), wanted, ["digest"], spread, "left")
        return marked.where("not hit").select(marked.columns[:size]), found


def _head():
    """The first 32 bits of a digest, at the top of a long."""
    return F.shiftleft(F.conv(F.rpad(F.hex(F.substring("digest", 1, 4)), 8, "0"), 16, 10).cast("long"), 32)


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:4].ljust(4, b"\0"), "big") >> (32 - SLOT_BITS)


def _filled(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 3] >> (slots & 7)) & 1).astype(bool)


def _least(a, b, pick):
    return b if a is None else a if b is None else pick(a, b)


def _merge(name: str):
    """Entries in order of digest -> one entry per digest. Only the entry in hand is held."""

    def run(batches: Iterator[pa.RecordBatch]):
        hand = None
        for b in batches:
            out: list[tuple] = []
            for d, first, last, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if hand is not None and hand[0] == d:
                    hand = (d, _least(hand[1], first, min), _least(hand[2], last, max), hand[3] + n)
                else:
                    if hand is not None:
                        out.append(hand)
                    hand = (d, first, last, n)
            yield _run_batch(name, out)
        if hand is not None:
            yield _run_batch(name, [hand])

    return run


def _run_batch(name: str, entries: list[tuple]) -> pa.RecordBatch:
    digest, first, last, n = zip(*entries, strict=True) if entries else ((),) * 4
    arrays = [pa.array([name] * len(digest), pa.string()), pa.array(digest, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["run", "digest", "first_id", "last_id", "n"])


def _digests(docs: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """(doc_id, sha, digest) per row."""
    size = digest_bits // 8

    def run(batches):
        for b in batches:
            sha = [hashlib.sha256(t.lower() if t else b"").digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), pa.array([s[:size] for s in sha], pa.binary())], ["doc_id", "sha", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sha binary, digest binary")


def _texts_of_hits(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """(digest, doc_id, text) of the rows whose digest the filter lets through; other texts are not shuffled."""
    seen = docs.sparkSession.sparkContext.broadcast(slot_filter(hits, _head(), SLOT_BITS))
    size = digest_bits // 8

    def run(batches):
        filled = seen.value
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = t.lower() if t else b""
                digest = hashlib.sha256(text).digest()[:size]
                slot = _slot(digest)
                if filled[slot >> 3] >> (slot & 7) & 1:
                    out.append((digest, i, text))
            if out:
                d, i, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(i, pa.int64()), pa.array(t, pa.binary())], ["digest", "doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "digest binary, doc_id long, text binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bits: int = 256) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, sha).

    Texts are equal when their bytes are, after lower-casing A-Z; null counts as empty. ``keep`` says whether the
    smallest or largest id of a group stays. Of repeated rows with the id that stays one is kept. Null ids stay
    only in groups without any other. Very long texts are hashed whole; further columns are ignored, whatever their
    names. ``digest_bits`` (a multiple of 8, 8 to 256) is the length of the indexed
    digest; short ones collide and rely on the byte verification. No rows: no result rows."""
    if keep not in ("smallest", "largest") or digest_bits % 8 or not 8 <= digest_bits <= 256:
        raise ValueError("keep is smallest or largest; digest_bits a multiple of 8 from 8 to 256")
    best = (lambda c: F.min(c)) if keep == "smallest" else (lambda c: F.max(c))
    rows = cut(_digests(docs, id_col, text_col, digest_bits))
    index = DigestIndex(docs.sparkSession)
    index.add(rows)
    entry = F.col("first_id" if keep == "smallest" else "last_id")
    hits = cut(index.entries().where("n > 1").select("digest", entry.alias("best_id"), "n"))
    alone, found = index.lookup(rows, hits, ["doc_id"])
    # One entry per digest is a group of one: it has no hit, whatever the filter says.
    same = found.groupBy("sha", "digest", "doc_id").agg(F.count("*").alias("times"), F.first("best_id").alias("best_id"), F.first("n").alias("n"))
    texts = _texts_of_hits(docs, hits, id_col, text_col, digest_bits)
    texts = store(salted_join(texts, hits, ["digest"], ["doc_id"]))
    stays = texts.where(F.col("doc_id").eqNullSafe(F.col("best_id"))).groupBy("digest").agg(F.min("text").alias("its_text"))
    odd = cut(salted_join(texts, stays, ["digest"], ["doc_id"]).where("text <> its_text").select("digest").distinct())
    if not odd.isEmpty():  # one digest, several texts
        by_text = salted_join(texts, odd, ["digest"], ["doc_id"], "left_semi").groupBy(F.sha2("text", 256).alias("hex"), "text")
        by_text = by_text.agg(best("doc_id").alias("best_of_text"), F.count("*").alias("n_of_text"))
        split = cut(by_text.select(F.unhex("hex").alias("sha"), "best_of_text", "n_of_text"))
        same = salted_join(same, split, ["sha"], ["doc_id"], "left")
        same = same.withColumn("best_id", F.when(F.col("n_of_text").isNull(), F.col("best_id")).otherwise(F.col("best_of_text"))).withColumn("n", F.coalesce("n_of_text", "n"))
    found = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    found = found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("sha"),
    )
    one = F.lit(1).cast("long")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("sha"))
    return alone.unionByName(found)


#: op4 for DuckDB.
DEDUP_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, doc_id = MAX(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
