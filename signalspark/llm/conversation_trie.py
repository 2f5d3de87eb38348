"""Prefix trie of conversations by Patricia construction over range-sorted paths.

A conversation becomes a path: one fixed-length unit (hash and words of a turn) after another, so paths sort as the
trie's leaves stand. Paths are range-partitioned and sorted with their ids; a partition makes the points of its part of
the trie only, branches, ends and leaves, with compressed edges between them, from the common prefixes of neighbours.
Sums over subtrees are taken at points; nodes of an edge are told apart afterwards by suffix sums of their words.

What lies on a partition's first and last path may go on in other partitions. These nodes (two paths a partition) are merged by
the hash of their prefix; sums below them are put together from what each partition has closed. A turn or conversation that
a third of all rows share is dealt to many partitions, and only its prefix is merged.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import store

WORDS = r"[^\x20\x09-\x0D]+"
UNIT = 40  # hex digits: 32 of the turn's SHA-256, 8 of its words
EMPTY = hashlib.sha256(b"").hexdigest()
PART_BYTES = 32 << 20
CHUNK = 1 << 16  # ids told in one row


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, units): the turns of each conversation in order, partitioned by twenties of ids.

    Order is by turn, null first; of equal turns by the hash of role and text. Null role and text count as empty.
    Rows without conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A
    conversation is held in one row of 40 bytes a turn, however long its texts are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    words = F.regexp_count(text, F.lit(WORDS))
    unit = F.concat(F.substring(F.sha2(named, 256), 1, UNIT - 8), F.lpad(F.hex(words.cast("long")), 8, "0"))
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col)
    rows = turns.where(conv.isNotNull()).select(conv.alias("conv_id"), twenty(conv).alias("base"), turn.isNotNull().alias("has"), turn.alias("turn"), unit.alias("unit"))
    each = F.sort_array(F.collect_list(F.struct("has", "turn", "unit"))).getField("unit")
    return rows.repartition("base").groupBy("base", "conv_id").agg(each.alias("units"))


def twenty(conv):
    return conv - conv % 20


def shared_starts(convs: DataFrame) -> DataFrame:
    """Paths rebuilt: the first h turns of the conversation of the twenty's least id, then the own ones after h.

    h is crc32 of the id in decimal, mod 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("units", 1, 3))).over(Window.partitionBy("base"))
    rows = convs.withColumn("h", h).withColumn("first", F.coalesce(first, F.array().cast("array<string>")))
    head = F.when(F.col("h") > 0, F.slice("first", F.lit(1), F.col("h"))).otherwise(F.array().cast("array<string>"))
    own = F.slice("units", F.col("h") + 1, F.greatest(F.size("units"), F.lit(1)))
    return rows.select("conv_id", F.array_join(F.concat(head, own), "").alias("path"))


# --- the part of the trie that a partition holds --------------------------------------------------------------
class _Point:
    """A branch, end or leaf; ``leaves`` and ``below`` are sums over closed children."""

    __slots__ = ("below", "children", "closed", "depth", "end", "last", "least", "leaves", "lo", "n")

    def __init__(self, depth: int, lo: int, n: int = 0, least: int | None = None, end: int = -1):
        self.depth, self.lo, self.n, self.least, self.end = depth, lo, n, least, end
        self.children, self.leaves, self.below, self.closed, self.last = 0, 0, 0, [], False


def _common(a: str, b: str) -> int:
    """Units that both paths begin with."""
    k = 0
    while k < len(a) and a[k : k + UNIT] == b[k : k + UNIT]:
        k += UNIT
    return k // UNIT


def _edge_sums(path: str, top: int, depth: int) -> list[int]:
    """Words of the units from each depth in (top, depth] to the edge's lower end: suffix sums."""
    out, total = [], 0
    for d in range(depth, top, -1):
        total += int(path[UNIT * d - 8 : UNIT * d], 16)
        out.append(total)
    return out[::-1]


def _prefix_keys(path: str) -> list[str]:
    seen, out = hashlib.sha256(), [EMPTY]
    for d in range(0, len(path), UNIT):
        seen.update(path[d : d + UNIT].encode())
        out.append(seen.hexdigest())
    return out


ROW = {
    "kind": pa.string(),
    "pid": pa.int32(),
    "side": pa.int32(),
    "depth": pa.int64(),
    "key": pa.string(),
    "parent_key": pa.string(),
    "conv_id": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "words": pa.int64(),
    "ends_sha256": pa.string(),
    "ids": pa.string(),
}
ROW_SQL = ", ".join(f"{c} {dict(int64='long', int32='int').get(str(t), str(t))}" for c, t in ROW.items())


class _Part:
    """Rows of the sorted paths of a partition: ``node`` is done but for its parent's id where ``parent_key`` is set,
    ``open`` is a node of the first (side 0) or last (side 1) path, ``ids`` tells conversations that end in an open node."""

    def __init__(self, pid: int, found: list[tuple[str, list[int]]]):
        self.pid, self.found, self.rows = pid, found, []
        self.keys = {0: _prefix_keys(found[0][0]), 1: _prefix_keys(found[-1][0])}

    def _emit(self, **values) -> None:
        self.rows.append(tuple(values.get(c) for c in ROW))

    def build(self) -> list[tuple]:
        stack, before = [_Point(0, 0)], ""
        for i, (path, ids) in enumerate(self.found):
            self._close(stack, _common(before, path), False)
            if path:
                stack.append(_Point(len(path) // UNIT, i, len(ids), ids[0], i))
            else:
                stack[0].n, stack[0].least, stack[0].end = len(ids), ids[0], i
            before = path
        self._close(stack, 0, True)
        root = stack[0]
        root.last = True
        self._children(root, True)
        self._open(root, -1)
        return self.rows

    def _close(self, stack: list[_Point], depth: int, last: bool) -> None:
        while stack[-1].depth > depth:
            top = stack.pop()
            top.last = last
            if stack[-1].depth < depth:
                stack.append(_Point(depth, top.lo))
            self._attach(top, stack[-1])

    def _attach(self, p: _Point, parent: _Point) -> None:
        parent.n += p.n
        parent.least = p.least if parent.least is None else min(parent.least, p.least)
        is_open = p.lo == 0 or p.last
        self._children(p, is_open)
        if is_open:
            self._open(p, parent.depth)
            return
        sums = _edge_sums(self.found[p.lo][0], parent.depth, p.depth) if p.n > 1 else None
        leaves = p.leaves or 1
        parent.children += 1
        parent.leaves += leaves
        parent.below += p.below + ((p.n - 1) * sums[0] if sums else 0)
        parent.closed.append((p, parent.depth, leaves, sums))

    def _children(self, p: _Point, is_open: bool) -> None:
        """Tells the edges to closed children, as ``p``'s least id is known now, or its key where it is open."""
        side = 1 if p.last else 0
        for child, top, leaves, sums in p.closed:
            for d in range(top + 1, child.depth + 1):
                lower = d == child.depth
                ends = EMPTY
                if lower and child.end >= 0:
                    ends = hashlib.sha256(",".join(map(str, self.found[child.end][1])).encode()).hexdigest()
                parent = child.least if d > top + 1 else None if is_open else p.least
                self._emit(
                    kind="node",
                    pid=self.pid,
                    depth=d,
                    parent_key=self.keys[side][p.depth] if parent is None else None,
                    conv_id=child.least,
                    parent_conv_id=parent,
                    n_convs=child.n,
                    n_children=child.children if lower else 1,
                    n_leaves=leaves,
                    saved_tokens=child.below + ((child.n - 1) * sums[d - top - 1] if sums else 0),
                    ends_sha256=ends,
                )
        p.closed = []

    def _open(self, p: _Point, top: int) -> None:
        """Tells the nodes of the edge above an open point, with what is closed below them here."""
        side = 1 if p.last else 0
        path, keys = self.found[p.lo][0], self.keys[side]
        for d in range(top + 1, p.depth + 1):
            lower = d == p.depth
            self._emit(
                kind="open",
                pid=self.pid,
                side=side,
                depth=d,
                key=keys[d],
                parent_key=keys[d - 1] if d else None,
                conv_id=p.least,
                n_convs=p.n,
                n_children=p.children if lower else 0,
                n_leaves=p.leaves if lower else 0,
                saved_tokens=p.below if lower else 0,
                words=int(path[UNIT * d - 8 : UNIT * d], 16) if d else 0,
            )
        if p.end >= 0:
            ids = self.found[p.end][1]
            for k in range(0, len(ids), CHUNK):
                self._emit(kind="ids", pid=self.pid, depth=k, key=keys[p.depth], ids=",".join(map(str, ids[k : k + CHUNK])))


def _build(batches):
    """A partition's part of the trie; it holds the partition, which ``prefix_trie`` keeps to some megabytes."""
    pairs = [(p, i) for b in batches for p, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    if pairs:
        found = [(path, [i for _, i in rows]) for path, rows in groupby(pairs, itemgetter(0))]
        rows = _Part(TaskContext.get().partitionId(), found).build()
        for k in range(0, len(rows), CHUNK):
            cols = zip(*rows[k : k + CHUNK], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ROW.values(), strict=True)], list(ROW))


def _digest_ids(batches):
    """SHA-256 of the ids of each key, streamed in order; only the hash state is held."""
    key, state = None, None
    for b in batches:
        keys, digests = [], []
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends"])


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, path): (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).

    A node is a distinct sequence of first turns, the root the empty one; conv_id is its smallest member. Conversations
    without turns end in the root. Equal paths are members of the same nodes, ordered by id. Very long texts do not
    matter, as paths hold hashes. No conversations: no rows, not even a root. Further columns are ignored."""
    spark = rows.sparkSession
    rows = store(rows.select("path", "conv_id"))
    total = rows.agg(F.sum(F.octet_length("path") + 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    rows = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    built = store(rows.mapInArrow(_build, ROW_SQL))

    opened = built.where("kind = 'open'").select("pid", "side", "depth", "key", "parent_key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")
    merged = opened.groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("depth", "parent_key", "words")),
        F.min("conv_id").alias("conv_id"),
        F.min("pid").alias("owner"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    merged = store(merged)
    branches = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("branches"))
    nodes = merged.join(branches, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("branches", F.lit(0)))
    worth = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")
    nodes = store(nodes.withColumn("saved_tokens", worth).withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")))

    # Sums below open nodes: each node counts in the partition that first has it, whose open paths hold all above it.
    at = opened.select("pid", "side", "depth", "key").join(nodes.select("key", "owner", "n_leaves", "saved_tokens"), "key")
    down = Window.partitionBy("pid", "side").orderBy(F.desc("depth"))
    own = F.col("owner") == F.col("pid")
    off = F.min(F.when(F.col("side") == 0, F.col("depth"))).over(Window.partitionBy("pid"))
    sums = at.withColumn("off", off)
    for c in ("n_leaves", "saved_tokens"):
        mine = F.when(own, F.col(c)).otherwise(0)
        aside = F.coalesce(F.sum(F.when(F.col("side") == 0, mine)).over(Window.partitionBy("pid")), F.lit(0))
        sums = sums.withColumn(f"{c}_sum", F.sum(mine).over(down) + F.when((F.col("side") == 1) & (F.col("depth") < F.col("off")), aside).otherwise(0))
    sums = sums.groupBy("key").agg(F.sum("n_leaves_sum").alias("n_leaves"), F.sum("saved_tokens_sum").alias("saved_tokens"))

    ids = built.where("kind = 'ids'").select("key", "ids", "pid", "depth")
    ids = ids.repartition("key").sortWithinPartitions("key", "pid", "depth").select("key", "ids").mapInArrow(_digest_ids, "key string, ends string")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    spine = nodes.drop("n_leaves", "saved_tokens").join(sums, "key").join(ids, "key", "left").join(above, "parent_key", "left")
    spine = spine.withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).select(RESULT)

    done = built.where("kind = 'node'")
    # Children of open nodes find their parent by partition and key: however many the root has, a partition has few.
    near = opened.select("pid", "key").join(merged.select("key", F.col("conv_id").alias("its_conv")), "key").withColumnRenamed("key", "parent_key")
    under = done.where("parent_key is not null").drop("parent_conv_id").join(near, ["pid", "parent_key"]).withColumnRenamed("its_conv", "parent_conv_id")
    return done.where("parent_key is null").select(RESULT).unionByName(under.select(RESULT)).unionByName(spine)


#: op11 for DuckDB.
TRIE_SQL = r"""
WITH crc AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(conv_id::VARCHAR) + 1), lambda i: list_transform(range(8), lambda b: ((ascii(substr(conv_id::VARCHAR, i::INT, 1)) >> b::INT) & 1)::BIGINT)))),
    lambda c, b: xor(c >> 1, ((xor(c, b) & 1) * 3988292384))) AS c FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM crc),
turns AS (SELECT conv_id, md5(COALESCE(role, '') || chr(1) || COALESCE(text, '')) AS u, len(list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, u) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (SELECT c.conv_id, t.pos, t.u, t.words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < h
  UNION ALL SELECT c.conv_id, t.pos, t.u, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= h),
path AS (SELECT conv_id, u, words, row_number() OVER w AS depth, md5(string_agg(u, '') OVER w) AS key FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
member AS (SELECT conv_id, depth, key, words, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM path UNION ALL SELECT conv_id, 0, '', 0, NULL FROM convs),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(key, depth) AS key FROM member GROUP BY conv_id) GROUP BY key),
node AS (SELECT key, MIN(depth) AS depth, MIN(words) AS words, MIN(parent) AS parent, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs FROM member GROUP BY key),
kids AS (SELECT parent AS key, COUNT(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
full_node AS (SELECT n.*, COALESCE(k.n, 0) AS n_children FROM node n LEFT JOIN kids k USING (key)),
below AS (SELECT m.key, SUM((n.n_children = 0)::INT)::BIGINT AS n_leaves, SUM((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM full_node n JOIN member m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, COALESCE(e.ends, sha256('')) AS ends_sha256
FROM full_node n JOIN below b USING (key) LEFT JOIN ends e USING (key) LEFT JOIN node p ON p.key = n.parent
"""
