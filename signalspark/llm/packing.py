"""Conflict-constrained best-fit packing of documents into fixed token budgets.

A hash spreads the pieces over shards of a bounded number of rows; each shard is packed on its own, largest
piece first. Open bins are ordered by what is left in them. A bin carries bitmaps: one bit per source for each
level of use (the last level set means that the source has had its share of the bin), and one bit per
duplicate cluster. The search starts at the least residual that holds the piece and goes on to the next
larger one until a bin has neither the cluster's bit nor the source's last level. Bins alike in residual and
bitmaps are interchangeable and are tried once, so a cluster or source with a third of all rows does not make
the search walk through its many bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import ascii_lower
from signalspark.llm.mixing import word_count

SCHEMA = "doc_id long, piece int, n_tokens long, source string, cluster long, bin_id long, bin_offset long, bin_tokens long"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin number and offset in the bin of each piece, in the order given. A null cluster conflicts with none."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    repeated = [c for c, n in Counter(clusters).items() if n > 1 and c is not None]
    cluster_bit = {c: 1 << i for i, c in enumerate(repeated)}
    residuals: list[int] = []  # ordered; of bins that are open
    bins: dict[int, dict[tuple, list[int]]] = {}  # residual -> (source levels, clusters) -> bins
    fresh = (0,) * per_source + (0,)
    bin_of, offset, made = [], [], 0
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        chosen, left, marks = made, capacity, fresh
        for at in range(bisect_left(residuals, size), len(residuals)):
            alike = bins[residuals[at]]
            marks = next((m for m in alike if not (m[-2] & s or m[-1] & c)), None)
            if marks is not None:
                left = residuals[at]
                chosen = alike[marks].pop()
                if not alike[marks]:
                    del alike[marks]
                    if not alike:
                        del bins[left], residuals[at]
                break
        else:
            made, marks = made + 1, fresh
        bin_of.append(chosen)
        offset.append(capacity - left)
        level = next(i for i in range(per_source) if not marks[i] & s)
        marks = (*(m | s if i == level else m for i, m in enumerate(marks[:-1])), marks[-1] | c)
        left -= size
        if left not in bins:
            insort(residuals, left)
        bins.setdefault(left, {}).setdefault(marks, []).append(chosen)
    return bin_of, offset


def pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, source, cluster): a document longer than a bin becomes whole bins and a rest."""
    text = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    cluster = F.xxhash64(text) if cluster_col is None else F.col(cluster_col).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(text_col).alias("tokens"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"))
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("tokens") / capacity) - 1).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    size = F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece").cast("long") * capacity)
    return rows.select("doc_id", "piece", size.alias("n_tokens"), "source", "cluster")


def pack(
    docs: DataFrame,
    capacity: int = 4096,
    per_source: int = 8,
    shard_rows: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
) -> DataFrame:
    """One row per piece: (doc_id, piece, n_tokens, source, cluster, bin_id, bin_offset, bin_tokens).

    No bin holds more than ``capacity`` words, two documents of one duplicate cluster, or more than
    ``per_source`` pieces of a source. Clusters are documents equal up to A-Z case and white space unless
    ``cluster_col`` names them; a null in it conflicts with nothing. Null and wordless texts are pieces of
    size 0 and find a bin like any other; null sources are one source. Repeated rows are packed each for itself
    (they share a cluster, so never a bin). No rows: no bins."""
    rows = pieces(docs, capacity, id_col, text_col, source_col, cluster_col)
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards).cast("long")))

    def run(key, t):
        t = t.drop_columns(["shard"]).sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        sizes = t.column("n_tokens").to_pylist()
        bin_of, offset = best_fit(sizes, t.column("source").to_pylist(), t.column("cluster").to_pylist(), capacity, per_source)
        tokens = [0] * (max(bin_of) + 1)
        for k, n in zip(bin_of, sizes, strict=True):
            tokens[k] += n
        first = key[0].as_py() << 32
        for name, values in (("bin_id", [first + k for k in bin_of]), ("bin_offset", offset), ("bin_tokens", [tokens[k] for k in bin_of])):
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t.select(["doc_id", "piece", "n_tokens", "source", "cluster", "bin_id", "bin_offset", "bin_tokens"])

    return rows.groupBy("shard").applyInArrow(run, SCHEMA)
