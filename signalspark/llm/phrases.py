"""Phrase collocations: frequent phrases of a language and how firmly they hold together at their weakest cut.

Texts become blocks of word numbers, one language a block, stored once. Phrases are counted level by level, words first.
At level k a block takes the places where both (k-1)-word phrases inside are frequent: no phrase that reaches the least
count is missed (Apriori). It numbers its distinct phrases (slots), bincounts them, and sends keys and counts to ranges of
the key's hash. Pairs, the bulk, are screened before: a range adds up counts by 32 further bits of the hash, and only pairs
whose sum reaches the least count, which holds for every frequent one, send their keys. A range puts the keys into a minimal perfect hash that stores them, so that a key finds its slot only if
the stored one is the same, and adds up the blocks' counts by slot. Blocks get the sums of their frequent phrases back.
In the end a block reads the counts of both sides of every cut by slot, for the phrases that it was the first to send.

One hash for the whole corpus would not fit a broadcast where phrases grow with the data; a range holds what some
megabytes of text send. A block sends a phrase once whatever its count, so frequent words load no range.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.blocks import part_bits_of
from signalspark.llm.common import shared_folder, store

BREAK = b"\xff"  # ends a piece; no byte of UTF-8
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
LONGEST = 4
SCREENED = (2,)  # levels whose keys are sent only if their short hashes are frequent
SCALE = 2_000_000
U = np.uint64


# --- a minimal perfect hash that stores its keys -------------------------------------------------------------
def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers."""
    x = (a ^ (b * U(0x9E3779B97F4A7C15) + U(0x7F4A7C15))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class PerfectHash:
    """Slots 0 to ``size`` - 1 for distinct 128-bit keys, each stored in its slot.

    Built in rounds: a key takes its place in a round's table unless another key is there, which leaves it to the next
    round. Rows of equal keys share a place. Taken places are numbered without gaps."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.rounds, self.size = [], 0
        highs, lows = [], []
        left = np.arange(len(high))
        while len(left):
            places = 1 << max(4, int(len(left)).bit_length())
            at = self._place(high[left], low[left], len(self.rounds), places)
            holder = np.full(places, -1, np.int64)
            holder[at] = left
            held = holder[at]
            mine = (high[held] == high[left]) & (low[held] == low[left])
            taken = holder >= 0
            number = np.cumsum(taken) - 1 + self.size
            self.rounds.append((taken, number))
            highs.append(high[holder[taken]])
            lows.append(low[holder[taken]])
            self.size += int(taken.sum())
            left = left[~mine]
        self.high = np.concatenate(highs) if highs else np.empty(0, U)
        self.low = np.concatenate(lows) if lows else np.empty(0, U)

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, no: int, places: int) -> np.ndarray:
        return (mix(high, low + U(no)) & U(places - 1)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that is not stored."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for no, (taken, number) in enumerate(self.rounds):
            at = self._place(high[left], low[left], no, len(taken))
            slot = np.where(taken[at], number[at], -1)
            same = (slot >= 0) & (self.high[slot] == high[left]) & (self.low[slot] == low[left])
            out[left[same]] = slot[same]
            left = left[~same]
        return out


# --- blocks of word numbers ----------------------------------------------------------------------------------
BLOCK = "block long, lang string, n_words long, words binary, vocabulary binary"


def _cuts(text: bytes, size: int) -> list[bytes]:
    """A translated text in parts of ``size`` bytes, cut at ends of pieces; a longer piece stays whole."""
    out = []
    while len(text) > size:
        at = text.rfind(BREAK, 0, size)
        at = text.find(BREAK, size) if at < 0 else at
        if at < 0:
            break
        out.append(text[:at])
        text = text[at + 1 :]
    return [*out, text]


def word_blocks(docs: DataFrame, lang_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(blocks of one language each, stored as a table bucketed by block; bytes of all texts).

    ``words`` are 32-bit places in ``vocabulary`` (words joined by blanks), -1 where a piece ends."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * block_bytes)))
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def pack(block: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
        tokens = (b" " + BREAK + b" ").join(texts).replace(BREAK, b" " + BREAK + b" ").split()
        number = defaultdict()
        number.default_factory = number.__len__
        number[BREAK]  # 0
        words = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)) - 1
        cols = [[block], [lang], [int((words >= 0).sum())], [words.tobytes()], [b" ".join(list(number)[1:])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names)

    def run(batches):
        block, held, sizes = TaskContext.get().partitionId() << 32, defaultdict(list), defaultdict(int)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                for part in _cuts(text.lower().translate(PIECES), block_bytes):
                    held[lang].append(part)
                    sizes[lang] += len(part)
                    # The largest goes where all together pass four blocks, however many languages there are.
                    full = lang if sizes[lang] >= block_bytes else max(sizes, key=sizes.get) if sum(sizes.values()) >= 4 * block_bytes else None
                    if full is not None:
                        yield pack(block, full, held.pop(full))
                        sizes.pop(full)
                        block += 1
        for lang in list(held):
            yield pack(block, lang, held.pop(lang))
            block += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    name = f"word_blocks_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(run, BLOCK).write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, and ``table`` knows its buckets
    return table, total


# --- levels --------------------------------------------------------------------------------------------------
class _Level:
    """Distinct phrases of k words of a block: slots by place, keys and local counts by slot; then the corpus counts."""

    def __init__(self, slot: np.ndarray, high: np.ndarray, low: np.ndarray, first: np.ndarray):
        self.slot, self.high, self.low, self.first = slot, high, low, first
        self.counts = np.bincount(slot[slot >= 0], minlength=len(high))
        self.order = np.argsort(high, kind="stable")
        self.total = np.zeros(len(high), np.int64)
        self.mine = np.zeros(len(high), bool)


class Phrases:
    """The phrases of a block, level by level as far as replies have come."""

    def __init__(self, row: dict, replies: pa.Table, part_bits: int, levels: int, screened: bool = True):
        self.words = np.frombuffer(row["words"], np.int32)
        self.vocabulary = row["vocabulary"].split(b" ") if row["vocabulary"] else []
        lang = row["lang"].encode() + BREAK
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(lang + w) for w in self.vocabulary), ">u8").reshape(-1, 2).astype(U)
        first = np.full(len(self.vocabulary), -1, np.int64)
        at = np.flatnonzero(self.words >= 0)
        first[self.words[at[::-1]]] = at[::-1]
        self.levels = [None, _Level(self.words.astype(np.int64), keys[:, 0], keys[:, 1], first)]
        self._read(1, replies, part_bits)
        for k in range(2, levels + 1):
            self.levels.append(self._next(k))
            if k in SCREENED and (screened or k < levels):
                self._screen(k, replies, part_bits)
            self._read(k, replies, part_bits)

    def _next(self, k: int) -> _Level:
        below, word = self.levels[k - 1], self.levels[1]
        alive = np.where((below.slot >= 0) & (below.total > 0)[below.slot], below.slot, -1) if len(below.high) else below.slot
        at = np.flatnonzero((alive[:-1] >= 0) & (alive[1:] >= 0)) if len(alive) else np.empty(0, np.int64)
        last = self.words[at + k - 1].astype(np.int64)
        codes, first, slots = np.unique(alive[at] << 32 | last, return_index=True, return_inverse=True)
        slot = np.full(len(self.words), -1, np.int64)
        slot[at] = slots
        head, tail = codes >> 32, codes & 0xFFFFFFFF
        high = mix(below.high[head], word.high[tail] + U(k))
        low = mix(below.low[head] + U(k), word.low[tail])
        return _Level(slot, high, low, at[first])

    def _screen(self, k: int, replies: pa.Table, part_bits: int) -> None:
        """Leaves in the level's order the phrases that the ranges let through."""
        level = self.levels[k]
        parts = _parts(level.high[level.order], part_bits)
        keep = np.zeros(len(parts), bool)
        for n, p, m in zip(*(replies.column(c).to_pylist() for c in ("level", "part", "marks")), strict=True):
            if n == -k:
                a, b = np.searchsorted(parts, [p, p + 1])
                keep[a:b] = np.unpackbits(np.frombuffer(m, np.uint8), count=int(b - a))
        level.order = level.order[keep]

    def _read(self, k: int, replies: pa.Table, part_bits: int) -> None:
        level = self.levels[k]
        parts = _parts(level.high[level.order], part_bits)
        for n, p, m, t in zip(*(replies.column(c).to_pylist() for c in ("level", "part", "marks", "totals")), strict=True):
            if n == k:
                marks = np.frombuffer(m, np.uint8)
                start = np.searchsorted(parts, p)
                at = level.order[start : start + len(marks)][marks > 0]
                level.total[at] = np.frombuffer(t, np.int64)
                level.mine[at] = marks[marks > 0] == 2

    def text(self, at: int, k: int) -> str:
        return b" ".join(self.vocabulary[w] for w in self.words[at : at + k]).decode()


def _parts(high: np.ndarray, part_bits: int) -> np.ndarray:
    return (high >> U(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(high), np.int64)


SENT = "block long, part int, high binary, low binary, counts binary"
REPLY = "block long, level int, part int, marks binary, totals binary"


def _over_blocks(blocks: DataFrame, replies: DataFrame | None, work, schema: str) -> DataFrame:
    """``work(row of the block, its replies)`` per block. Blocks stay in their buckets; only replies are shuffled."""
    if replies is None:
        replies = blocks.select("block", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in REPLY.split(", ")[1:])).where("false")
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        found = [work(r, sent) for r in rows.to_pylist()]
        return pa.concat_tables(found).cast(fields) if found else fields.empty_table()

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def _packed(block: int, part: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """A row per range with the columns' values as bytes."""
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    ends = [*cuts[1:].tolist(), len(part)]
    packed = [pa.array([c[s:e].tobytes() for s, e in zip(cuts.tolist(), ends, strict=False)], pa.binary()) for c in columns]
    return pa.table([pa.array([block] * len(cuts), pa.int64()), pa.array(part[cuts].astype(np.int32)), *packed], [c.split()[0] for c in SENT.split(", ")])


def send_short(blocks: DataFrame, replies: DataFrame | None, k: int, part_bits: int, least: int) -> DataFrame:
    """Per block and range: 32 bits of the candidates' hashes behind those of the range, and counts up to ``least``."""
    kind = np.min_scalar_type(least)

    def work(row: dict, found: pa.Table) -> pa.Table:
        level = Phrases(row, found, part_bits, k, screened=False).levels[k]
        high = level.high[level.order]
        short = ((high << U(part_bits)) >> U(32)).astype(np.uint32)
        counts = np.minimum(level.counts[level.order], least).astype(kind)
        return _packed(row["block"], _parts(high, part_bits), [short, np.empty(0, np.uint32), counts])

    return _over_blocks(blocks, replies, work, SENT)


def screen(sent: DataFrame, k: int, least: int) -> DataFrame:
    """Per block and range: a bit per candidate, 1 where all with its short hash together reach ``least``."""
    kind = np.min_scalar_type(least)

    def run(t: pa.Table) -> pa.Table:
        short, counts = (np.concatenate([np.frombuffer(b.as_buffer(), d) for b in t.column(c)]) for c, d in (("high", np.uint32), ("counts", kind)))
        sizes = np.array([len(b.as_buffer()) // 4 for b in t.column("high")])
        _, slots = np.unique(short, return_inverse=True)
        enough = (np.bincount(slots, weights=counts) >= least)[slots]
        parts = np.split(enough, np.cumsum(sizes)[:-1])
        some = [i for i, p in enumerate(parts) if p.any()]
        cols = [t.column("block").take(pa.array(some, pa.int64())), pa.array([-k] * len(some), pa.int32()), t.column("part").take(pa.array(some, pa.int64()))]
        cols += [pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary()), pa.array([b""] * len(some), pa.binary())]
        return pa.table(cols, [c.split()[0] for c in REPLY.split(", ")])

    return sent.groupBy("part").applyInArrow(run, REPLY)


def send(blocks: DataFrame, replies: DataFrame | None, k: int, part_bits: int) -> DataFrame:
    """Per block and range, packed and in order: keys of the k-word candidates and their counts in the block."""

    def work(row: dict, found: pa.Table) -> pa.Table:
        level = Phrases(row, found, part_bits, k).levels[k]
        high, low, counts = level.high[level.order], level.low[level.order].astype(np.uint32), level.counts[level.order].astype(np.int32)
        return _packed(row["block"], _parts(high, part_bits), [high, low, counts])

    return _over_blocks(blocks, replies, work, SENT)


def count(sent: DataFrame, k: int, least: int) -> DataFrame:
    """Per block and range: a byte per key sent (0 rare, 1 frequent, 2 frequent and this block's to tell) and the
    corpus counts of the frequent ones. Keys have 96 bits."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        high, low, counts = (np.concatenate([np.frombuffer(b.as_buffer(), d) for b in t.column(c)]) for c, d in (("high", U), ("low", np.uint32), ("counts", np.int32)))
        low = low.astype(U)
        sizes = np.array([len(b.as_buffer()) // 8 for b in t.column("high")])
        table = PerfectHash(high, low)
        slots = table.slots(high, low)
        totals = np.zeros(table.size, np.int64)
        for s, c in zip(np.split(slots, np.cumsum(sizes)[:-1]), np.split(counts, np.cumsum(sizes)[:-1]), strict=True):
            totals[s] += c  # a block sends a key once
        owner = np.empty(table.size, np.int64)
        owner[slots[::-1]] = np.arange(len(slots))[::-1]
        marks = (totals[slots] >= least).astype(np.uint8)
        marks[(owner[slots] == np.arange(len(slots))) & (marks > 0)] = 2
        parts, sums = np.split(marks, np.cumsum(sizes)[:-1]), np.split(totals[slots], np.cumsum(sizes)[:-1])
        some = [i for i, p in enumerate(parts) if p.any()]
        cols = [t.column("block").take(pa.array(some, pa.int64())), pa.array([k] * len(some), pa.int32()), t.column("part").take(pa.array(some, pa.int64()))]
        cols += [pa.array([parts[i].tobytes() for i in some], pa.binary()), pa.array([sums[i][parts[i] > 0].tobytes() for i in some], pa.binary())]
        return pa.table(cols, [c.split()[0] for c in REPLY.split(", ")])

    return sent.groupBy("part").applyInArrow(run, REPLY)


TOLD = "lang string, phrase string, a long, l long, r long, score long, inside boolean"


def tell(blocks: DataFrame, replies: DataFrame, part_bits: int, percent: int) -> DataFrame:
    """Each frequent phrase of two words and more with its weakest cut, once, and a row ``inside`` for each phrase that a
    longer one of at least ``percent`` of its count holds."""

    def work(row: dict, found: pa.Table) -> pa.Table:
        p = Phrases(row, found, part_bits, LONGEST)
        out = []
        for k in range(2, LONGEST + 1):
            level = p.levels[k]
            for s in np.flatnonzero(level.mine).tolist():
                at, a = int(level.first[s]), int(level.total[s])

                def total(start: int, n: int, at: int = at) -> int:
                    return int(p.levels[n].total[p.levels[n].slot[at + start]])

                cuts = [(SCALE * a // (total(0, j) + total(j, k - j)), j) for j in range(1, k)]  # whole numbers of any size
                score, j = min(cuts)
                out.append((p.text(at, k), a, total(0, j), total(j, k - j), score, False))
                for n in range(2, k):
                    out += [(p.text(at + i, n), None, None, None, None, True) for i in range(k - n + 1) if 100 * a >= percent * total(i, n)]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
        return pa.table([pa.array([row["lang"]] * len(out), pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [c.split()[0] for c in TOLD.split(", ")])

    return _over_blocks(blocks, replies, work, TOLD)


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, percent: int = 80, first: int = 2000, block_bytes: int = 8 << 20
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by score, count and bytes.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. Phrases have two to four words of
    one piece and ``least`` occurrences, overlaps included. ``l`` and ``r`` are the counts of both sides of the cut with
    the least score floor(2,000,000 a / (l + r)), the shortest first part of equal ones; ``n`` is the words of the language.
    Phrases inside a longer one of at least ``percent`` of their count are left out, whether or not that one is.

    Null and empty texts have no words; a null language is ``und``, as is one of that name. Very long texts are cut at ends
    of pieces into several blocks. Every row counts, repeated rows and copies too. Ties of score and count go by the
    phrase's bytes. No rows, or no frequent phrase: no result rows. Further columns are ignored, whatever their names."""
    blocks, total = word_blocks(docs, lang_col, text_col, block_bytes)
    part_bits = part_bits_of(total)
    replies = store(count(send(blocks, None, 1, part_bits), 1, least))
    for k in range(2, LONGEST + 1):
        if k in SCREENED:
            replies = replies.unionByName(store(screen(send_short(blocks, replies, k, part_bits, least), k, least)))
        replies = replies.unionByName(store(count(send(blocks, replies, k, part_bits), k, least)))
    told = tell(blocks, replies, part_bits, percent).groupBy("lang", "phrase")
    told = told.agg(*(F.max(c).alias(c) for c in ("a", "l", "r", "score", "inside"))).where("not inside and a is not null")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First of each share of a language, then of the language: no task sorts a language whole.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    told = told.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))).where(F.col("rank") <= first)
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= first)
    words = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return told.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: op12 for DuckDB.
PHRASES_SQL = r"""
WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM words, range(1, 5) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, COUNT(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, SUM(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT c.lang, c.k, c.phrase, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1 : c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, k, m, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM cand, range(2, 4) t(m) WHERE m < k) s
  JOIN cand c ON c.lang = s.lang AND c.phrase = s.phrase WHERE 100 * s.a >= 80 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b JOIN n USING (lang) WHERE NOT EXISTS (FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase)
QUALIFY rank <= 2000
"""
