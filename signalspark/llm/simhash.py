"""SimHash near-duplicates by a forest of vantage-point trees.

Two 64-bit fingerprints at most 3 bits apart agree, by the pigeonhole principle, on one of four 16-bit
blocks. The Hamming distance on a block is a metric bounded by the whole distance, so each block carries a
tree of its own: its vantage points are Walsh codewords, its shells the tuples of exact distances to them,
and the triangle bound |d(v,x) - d(v,y)| <= d(x,y) = 0 sends a fingerprint into one shell per tree. What
shares a shell is one shard. Inside a shard the same bound on whole fingerprints, now with radius 3, orders
the rows by distance to a vantage row and confines each search to a window of that order. A shard above
``shard_rows`` is cut into distance bands first, and each row is also sent to the bands that lie within
3 of its own, so that boundary pairs meet. All links found are exact; shards return spanning trees of their
links, not every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import cut
from signalspark.llm.components import connected_components

BITS = 64
BLOCK = 16
SMALL = 48  # shards up to this size are compared by row offset, many shards at once


def _walsh(row: int) -> int:
    """Row of the 16 x 16 Walsh matrix as a 16-bit codeword."""
    return sum((bin(row & i).count("1") & 1) << i for i in range(BLOCK))


VANTAGE_POINTS = [_walsh(i) for i in range(12)]
OCTET_STARTS = np.arange(8) * 256
OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats counted; 0 if there is no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return digest(join(words), 42)
    n = len(words) - shingle + 1
    hashes = np.array([digest(join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))], "<u8")
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 16):
        octets = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        seen = np.bincount((octets + OCTET_STARTS).ravel(), minlength=8 * 256).reshape(8, 256)
        ones += (seen @ OCTET_BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """One row (doc_id, fp) per input row, and the columns to ``carry``; fp is the fingerprint's bits as a signed long."""
    carry = carry or []

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *carry])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carry)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, fp long{kinds}")


def _shell(block: Column) -> Column:
    """The distances of a block to all vantage points, five bits each, in one long."""
    key = F.lit(0).cast("long")
    for v in VANTAGE_POINTS:
        key = F.shiftleft(key, 5).bitwiseOR(F.bit_count(block.bitwiseXOR(F.lit(v).cast("long"))).cast("long"))
    return key


def shards(classes: DataFrame, max_distance: int = 3) -> DataFrame:
    """(fp) -> (tree, shell, fp), one row per tree."""
    if max_distance >= BITS // BLOCK:
        raise ValueError(f"{BITS // BLOCK} trees find links of up to {BITS // BLOCK - 1} bits")
    per_tree = [
        F.struct(F.lit(t).alias("tree"), _shell(F.shiftrightunsigned("fp", BLOCK * t).bitwiseAND(F.lit(0xFFFF).cast("long"))).alias("shell"))
        for t in range(BITS // BLOCK)
    ]
    return classes.select("fp", F.explode(F.array(*per_tree)).alias("s")).select("s.tree", "s.shell", "fp")


def tree_links(fps: np.ndarray, max_distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph on ``fps`` (uint64) with an edge at ``max_distance`` bits or fewer.

    Rows are ordered by distance to a vantage row; a search looks only at rows not reached yet whose
    distance to the vantage row differs by at most max_distance."""
    d = np.bitwise_count(fps ^ fps[0]).astype(np.int16)
    order = np.argsort(d, kind="stable")
    x, d = fps[order], d[order]
    low, high = np.searchsorted(d, d - max_distance, "left"), np.searchsorted(d, d + max_distance, "right")
    fresh = np.ones(len(x), bool)
    a, b = [], []
    for start in range(len(x)):
        if not fresh[start]:
            continue
        fresh[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            near = low[i] + np.flatnonzero(fresh[low[i] : high[i]])
            near = near[np.bitwise_count(x[near] ^ x[i]) <= max_distance]
            if len(near):
                fresh[near] = False
                a.append(np.full(len(near), x[i]))
                b.append(x[near])
                todo.extend(near.tolist())
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _runs(batches, keys: int):
    """Sorted record batches -> column lists that hold whole runs of equal keys."""
    rest = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        other = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            other |= c != c[-1]
        end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if end:
            yield [c[:end] for c in cols]
        rest = [c[end:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _search(keys: int, max_distance: int):
    """Searches every shard; its rows follow each other, told apart by the first ``keys`` columns."""

    def links(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        for cols in _runs(batches, keys):
            x = np.ascontiguousarray(cols[keys]).view(np.uint64)
            new = np.ones(len(x), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(x)))
            left = np.repeat(starts + sizes, sizes) - np.arange(len(x))  # rows from here to the shard's end
            rows = np.flatnonzero((np.repeat(sizes, sizes) <= SMALL) & (left > 1))
            for off in range(1, SMALL):
                rows = rows[left[rows] > off]
                if not len(rows):
                    break
                hit = rows[np.bitwise_count(x[rows] ^ x[rows + off]) <= max_distance]
                if len(hit):
                    yield links(x[hit], x[hit + off])
            for s in np.flatnonzero(sizes > SMALL):
                a, b = tree_links(x[starts[s] : starts[s] + sizes[s]], max_distance)
                if len(a):
                    yield links(a, b)

    return run


def _bands(rows: DataFrame, sizes: DataFrame, max_distance: int, shard_rows: int) -> DataFrame:
    """Rows of large shards -> (tree, shell, one, two, fp), a row for every pair of bands that it takes part in."""
    rows = rows.join(sizes.select("tree", "shell", "vantage"), ["tree", "shell"])
    rows = rows.withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
    counts = rows.groupBy("tree", "shell", "d").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("slices"))
    counts = cut(counts)
    rows = rows.join(counts, ["tree", "shell", "d"])
    band = F.col("d").cast("long") * (1 << 32) + F.pmod(F.xxhash64("fp"), F.col("slices").cast("long"))
    rows = rows.select("tree", "shell", band.alias("band"), "fp")
    bands = counts.select("tree", "shell", "d", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    bands = bands.select("tree", "shell", "d", (F.col("d").cast("long") * (1 << 32) + F.col("slice")).alias("band"))
    a = bands.select("tree", "shell", F.col("d").alias("d1"), F.col("band").alias("one"))
    b = bands.select("tree", "shell", F.col("d").alias("d2"), F.col("band").alias("two"))
    near = a.join(b, ["tree", "shell"]).where(f"two >= one and d2 - d1 <= {max_distance}").select("tree", "shell", "one", "two")
    ends = near.withColumn("band", F.explode(F.array_distinct(F.array("one", "two"))))
    return rows.join(ends, ["tree", "shell", "band"]).select("tree", "shell", "one", "two", "fp")


def links(classes: DataFrame, max_distance: int = 3, shard_rows: int = 20_000) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what lies within ``max_distance`` bits."""
    rows = shards(classes, max_distance)
    sizes = rows.groupBy("tree", "shell").agg(F.count("*").alias("n"), F.min("fp").alias("vantage"))
    large = cut(sizes.where(F.col("n") > shard_rows))
    out = []
    if large.isEmpty():
        usual = rows
    else:
        usual = rows.join(large, ["tree", "shell"], "left_anti")
        bands = _bands(rows, large, max_distance, shard_rows)
        keys = ["tree", "shell", "one", "two"]
        out.append(bands.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(4, max_distance), "a long, b long"))
    keys = ["tree", "shell"]
    out.insert(0, usual.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(2, max_distance), "a long, b long"))
    return out[0] if len(out) == 1 else out[0].union(out[1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3, shard_rows: int = 20_000, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: (doc_id, fp, component_id, fingerprint).

    component_id is the smallest id reachable by links of ``max_distance`` bits or fewer, the row's own
    included. Null and wordless texts have fingerprint 0 and link like any other; a text of fewer words than a
    shingle is one shingle. Repeated rows each give a row. A null id never becomes a component_id unless all
    ids of the component are null. An empty table gives no rows; further columns are ignored, but those to
    ``carry`` come last, after ``root``, one number for each component."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle, carry))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(classes, max_distance, shard_rows))
    roots = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = cut(roots)
    low = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.join(low, "root").select("fp", "component_id", "root")
    out = rows.join(ids, "fp")
    return out.select("doc_id", "fp", "component_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), *(["root", *carry] if carry else []))
