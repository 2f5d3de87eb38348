"""Line dedup: lines that many documents hold are found by their hashes; documents get bitmaps of what to keep.

Lines are hashed (128 bits) in blocks of texts that stay where they are (``blocks``). Hashes are dealt to ranges of
their leading bits; a range sorts them by (hash, document, position) and streams over them: the first entry of a hash
is its first occurrence, and entries of further documents are counted. What returns to a block is a byte per hash it
sent, and a block turns that into one compressed bitmap of lines per document. No text is shuffled.

A document is told by its id and the SHA-256 of its text. A block that holds a line in enough documents to decide alone
sends it once, with that number, so a line that a third of all documents share costs each block one entry.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from signalspark.llm.blocks import part_bits_of, text_blocks, with_blocks

WHITE = b" \t\n\x0b\x0c\r"
DROP, LEAD = 1, 2  # marks of a hash: its lines go; its lines go but for the first of this block


def line_keys(text: bytes) -> list[bytes]:
    """Keys of the lines of a text: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(WHITE).lower() for line in text.split(b"\n")]


def pack_keep(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack_keep(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n_lines, bitorder="little").astype(bool)


def apply_keep(text: bytes, keep: np.ndarray) -> bytes:
    """The lines of a text whose bit is set, joined."""
    return b"\n".join(line for line, k in zip(text.split(b"\n"), keep, strict=True) if k)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class _Lines:
    """The lines of a block ordered by (hash, document, position)."""

    def __init__(self, rows: pa.Table, min_chars: int):
        self.texts = [t or b"" for t in rows.column("text").to_pylist()]
        keys = [line_keys(t) for t in self.texts]
        self.counts = np.array([len(k) for k in keys], np.int64)
        row = np.repeat(np.arange(len(keys)), self.counts)
        no = np.arange(len(row)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        flat = [k for of_text in keys for k in of_text]
        at = np.array([i for i, k in enumerate(flat) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)], np.int64)
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(flat[i]) for i in at.tolist()), ">u8").reshape(-1, 2).astype(np.uint64)
        row, no, high, low = row[at], no[at], both[:, 0], both[:, 1]
        ords = rows.column("ord").to_numpy()[row]
        sha = np.array([int.from_bytes(s[:8], "big", signed=True) for s in rows.column("sha").to_pylist()], np.int64)[row]
        order = np.lexsort((no, sha, ords, low, high))
        self.row, self.no, self.high, self.low, self.ords, self.sha = (c[order] for c in (row, no, high, low, ords, sha))
        new = _starts(self.high, self.low)
        self.first = np.flatnonzero(new)  # of each hash
        self.of = np.cumsum(new) - 1

    def entries(self, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of what is sent, its weight): each document of a hash, or one entry where there are enough here."""
        doc = np.flatnonzero(_starts(self.high, self.low, self.ords, self.sha))
        docs = np.bincount(self.of[doc], minlength=len(self.first))
        enough = docs >= min_docs
        lead = np.zeros(len(self.of), bool)
        lead[self.first] = True
        sent = doc[~enough[self.of[doc]] | lead[doc]]
        return sent, np.where(enough[self.of[sent]], min_docs, 1).astype(np.int32)


KINDS = {"high": np.uint64, "low": np.uint64, "ords": np.int64, "texts": np.int64, "lines": np.int64, "weights": np.int32}
SENT = "block long, part int, " + ", ".join(f"{c} binary" for c in KINDS)
COLUMNS = ["no", "ord", "doc_id", "sha", "text"]


def _parts(high: np.ndarray, part_bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(high), np.int64)


def send(blocks: DataFrame, min_docs: int, min_chars: int, part_bits: int) -> DataFrame:
    """Per block and range of hashes, packed and in order: hashes with document, position and weight."""

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        lines = _Lines(rows, min_chars)
        sent, weights = lines.entries(min_docs)
        cols = [lines.high[sent], lines.low[sent], lines.ords[sent], lines.sha[sent], lines.no[sent].astype(np.int64), weights]
        part = _parts(cols[0], part_bits)
        cuts = np.flatnonzero(_starts(part))
        ends = [*cuts[1:].tolist(), len(part)]
        packed = [pa.array([c[s:e].tobytes() for s, e in zip(cuts.tolist(), ends, strict=False)], pa.binary()) for c in cols]
        block = pa.array([rows.column("block")[0].as_py()] * len(cuts), pa.int64())
        return pa.table([block, pa.array(part[cuts].astype(np.int32)), *packed], [c.split()[0] for c in SENT.split(", ")])

    return with_blocks(blocks, blocks.select("block").where("false"), ["no", "ord", "sha", "text"], work, SENT)


def judge(sent: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """(block, part, marks): a byte per entry sent. Nothing where all are 0."""

    def run(t: pa.Table) -> pa.Table:
        cols = {c: np.concatenate([np.frombuffer(b.as_buffer(), k) for b in t.column(c)]) for c, k in KINDS.items()}
        sizes = np.array([len(b.as_buffer()) // 8 for b in t.column("high")])
        order = np.lexsort((cols["lines"], cols["texts"], cols["ords"], cols["low"], cols["high"]))
        high, low, ords, texts, lines = (cols[c][order] for c in ("high", "low", "ords", "texts", "lines"))
        new = _starts(high, low)
        doc = np.flatnonzero(_starts(high, low, ords, texts))
        # A repeated row is one document: of its entries the largest weight counts.
        weight = np.maximum.reduceat(cols["weights"][order].astype(np.int64), doc)
        of = np.cumsum(new) - 1
        docs = np.bincount(of[doc], weights=weight, minlength=int(new.sum()))
        marks = np.where(docs[of] >= min_docs, DROP, 0).astype(np.uint8)
        if keep_first:
            lead = np.flatnonzero(new)[of]
            first = (ords == ords[lead]) & (texts == texts[lead]) & (lines == lines[lead])
            marks[first & (marks > 0)] = LEAD
        back = np.empty_like(marks)
        back[order] = marks
        parts = np.split(back, np.cumsum(sizes)[:-1])
        some = np.array([k for k, p in enumerate(parts) if p.any()], np.int64)
        return pa.table([t.column("block").take(some), t.column("part").take(some), pa.array([parts[k].tobytes() for k in some.tolist()], pa.binary())], ["block", "part", "marks"])

    return sent.groupBy("part").applyInArrow(run, "block long, part int, marks binary")


RESULT = "doc_id long, n_lines long, n_dropped long, keep binary, text binary"


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    with_text: bool = False,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per input row: (doc_id, n_lines, n_dropped, keep, text).

    ``keep`` is a compressed bitmap of the lines that stay (``unpack_keep``); ``text`` is null unless ``with_text`` asks for
    the kept lines. Lines whose key has ``min_chars`` code points at least and lies in ``min_docs`` documents at least go
    everywhere, or, with ``keep_first``, everywhere but in their first place by (id, text's SHA-256, position).

    Null and empty texts are one empty line, which always stays: an empty key has no code points. Very long texts are
    blocks of their own and read whole. Rows of equal id and text, repeated rows too, are one document and are treated
    alike; equal ids with different texts, and null ids (last in order), are documents of their own. No rows: no result
    rows. Further columns are ignored, whatever their names."""
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars are 1 at least")
    blocks, total = text_blocks(docs, id_col, text_col, block_bytes)
    part_bits = part_bits_of(total)

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        lines = _Lines(rows, min_chars)
        sent, _ = lines.entries(min_docs)
        part, marks = _parts(lines.high[sent], part_bits), np.zeros(len(sent), np.uint8)
        for p, m in zip(found.column("part").to_pylist(), found.column("marks").to_pylist(), strict=True):
            at = np.searchsorted(part, p)
            marks[at : at + len(m)] = np.frombuffer(m, np.uint8)
        mark = np.zeros(len(lines.first), np.uint8)
        np.maximum.at(mark, lines.of[sent], marks)
        stays = np.zeros(len(lines.of), bool)
        lead = lines.first[mark == LEAD]
        stays[lead] = True
        # A repeated row keeps what its twin keeps.
        of_lead = np.full(len(lines.first), -1, np.int64)
        of_lead[lines.of[lead]] = lead
        twin = of_lead[lines.of]
        has = np.flatnonzero(twin >= 0)
        stays[has] = (lines.ords[has] == lines.ords[twin[has]]) & (lines.sha[has] == lines.sha[twin[has]]) & (lines.no[has] == lines.no[twin[has]])
        gone = (mark[lines.of] > 0) & ~stays
        keep = np.ones(int(lines.counts.sum()), bool)
        ends = np.cumsum(lines.counts)
        keep[(ends - lines.counts)[lines.row[gone]] + lines.no[gone]] = False
        keeps = np.split(keep, ends[:-1])
        kept = [apply_keep(t, k) if with_text else None for t, k in zip(lines.texts, keeps, strict=True)]
        dropped = lines.counts - np.array([int(k.sum()) for k in keeps], np.int64)
        cols = [rows.column("doc_id"), pa.array(lines.counts), pa.array(dropped), pa.array(map(pack_keep, keeps), pa.binary()), pa.array(kept, pa.binary())]
        return pa.table(cols, [c.split()[0] for c in RESULT.split(", ")])

    out = with_blocks(blocks, judge(send(blocks, min_docs, min_chars, part_bits), min_docs, keep_first), COLUMNS, work, RESULT)
    return out.withColumn("text", out["text"].cast("string"))


#: op13 for DuckDB.
LINES_SQL = """
WITH lines AS (SELECT doc_id, no, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 10)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(c.key) AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY doc_id
"""
