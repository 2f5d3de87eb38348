"""Texts in blocks that stay where they are, while what is found out about them comes to them.

A block holds the texts of some megabytes. The blocks of a corpus are stored once, as a table bucketed by block, so a
join on the block shuffles only the other side. Operators send short keys (hashes with their places) from blocks to
parts of the hash range, where equal keys meet, and get replies by block.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import shared_folder

PART_BYTES = 16 << 20  # bytes of text whose keys make one part
BLOCK_ROWS = 1 << 16
LAST = (1 << 63) - 1  # stands for a null id: after all others


def part_bits_of(total_bytes: int) -> int:
    """The number of leading bits of a hash that tell its part."""
    return max(0, (total_bytes // PART_BYTES).bit_length())


BLOCK = "block long, no int, ord long, doc_id long, size long, sha binary, text binary"


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """(rows told by (block, no), stored as a table bucketed by block; bytes of all texts).

    ``ord`` is the id, a null id last; ``sha`` is of the text's bytes, null as empty. A block has ``block_bytes`` of text,
    or one longer text."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * block_bytes)))
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches):
        block, no, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            texts = b.column(1).to_pylist()
            where, nos = [], []
            for t in texts:
                n = len(t or b"")
                if no and (held + n > block_bytes or no >= BLOCK_ROWS):
                    block, no, held = block + 1, 0, 0
                where.append(block)
                nos.append(no)
                no, held = no + 1, held + n
            sha = [hashlib.sha256(t or b"").digest() for t in texts]
            ords = b.column(0).fill_null(LAST)
            cols = [pa.array(where, pa.int64()), pa.array(nos, pa.int32()), ords, b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(sha, pa.binary()), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, names)

    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, BLOCK)
    name = f"text_blocks_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, and ``table`` knows its buckets
    return table, total


INFO = "block long, part int, nos array<int>, marks binary, starts array<int>, stops array<int>"


def info(df: DataFrame) -> DataFrame:
    """What is sent to blocks, in one shape."""
    kinds = dict(c.split() for c in INFO.split(", "))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def with_blocks(blocks: DataFrame, found: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(block table, info table)`` per block. Blocks stay in their buckets; only ``found`` is shuffled."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        return work(rows.sort_by("no"), sent) if rows.num_rows else fields.empty_table()

    left = blocks.select("block", *columns).groupBy("block")
    return left.cogroup(info(found).groupBy("block")).applyInArrow(run, schema)
