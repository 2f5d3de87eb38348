"""Substring dedup by sliding sentence spans.

Every run of ``span`` consecutive sentences is hashed (128 bits), the hashes are joined over the whole corpus,
and a sentence goes if a span that covers it is not the first of its kind. The first is the one with the least
(doc_id, digest of the text, place). Runs may adapt to the sentences' length (``run_ends``): a long passage may hold
fewer whole sentences than ``span``, and a few short sentences say little.

Texts are stored once in blocks (``blocks``). A block sends each digest once, with its first place in the block, to the
part of the hash range that the digest falls in; the part replies whose place is the first in the corpus. So a span
that a third of all documents share costs each block one entry, and no text is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from signalspark.llm.blocks import part_bits_of, text_blocks, with_blocks

#: A sentence with the white space that follows it; a line end ends one too.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)\s*|\n\s*|[.!?]+|$)")


def sentences(text: str) -> list[str]:
    """The sentences of a text; joined they give the text again."""
    return [s for s in SENTENCE.findall(text) if s]


def run_ends(sizes: np.ndarray, span: int, min_words: int, long_words: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs over counted sentences of ``sizes`` words, the end not included.

    A run has ``span`` sentences, or more until it has ``min_words`` words, or fewer as soon as it has ``long_words``
    words. Runs that the text's end cuts short are left out; a text too short for any run but of ``min_words`` words is one."""
    n, upto = len(sizes), np.r_[0, np.cumsum(sizes)]
    first = np.arange(n)
    end = np.maximum(first + span, np.searchsorted(upto, upto[:-1] + min_words))
    if long_words is not None:
        end = np.minimum(end, np.searchsorted(upto, upto[:-1] + long_words))
        if n and end[0] > n and upto[-1] >= min_words:
            return first[:1], np.array([n])
    return first[end <= n], end[end <= n]


def spans(parts: list[str], span: int, min_words: int = 0, long_words: int | None = None) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """(places of the counted sentences, first and end of the runs among them, digests of the runs).

    Sentences without letters or digits are not counted, but a run covers those inside it; case and white space do
    not matter. Without ``min_words`` and ``long_words`` a text of fewer counted sentences than ``span`` has no run."""
    words = [p.lower().split() for p in parts]
    solid = [i for i, w in enumerate(words) if any(any(map(str.isalnum, x)) for x in w)]
    encoded = [" ".join(words[i]).encode() for i in solid]
    first, end = run_ends(np.array([len(words[i]) for i in solid], np.int64), span, min_words, long_words)
    return solid, first, end, [xxhash.xxh3_128_digest(b"\0".join(encoded[k:e])) for k, e in zip(first.tolist(), end.tolist(), strict=True)]


def _block_spans(rows: pa.Table, rule: tuple):
    """(parts of each text, counted sentences of each text, then by run: row, first counted sentence, end, digest as two
    numbers)."""
    texts = [sentences(t.decode()) if t else [] for t in rows.column("text").to_pylist()]
    solids, row, firsts, ends, digests = [], [], [], [], []
    for k, parts in enumerate(texts):
        solid, first, end, found = spans(parts, *rule)
        solids.append(solid)
        row += [k] * len(found)
        firsts.append(first)
        ends.append(end)
        digests += found
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    none = np.zeros(0, np.int64)
    return texts, solids, np.array(row, np.int64), np.concatenate([none, *firsts]), np.concatenate([none, *ends]), both[:, 0], both[:, 1]


def _leaders(rows: pa.Table, row: np.ndarray, first: np.ndarray, high: np.ndarray, low: np.ndarray):
    """(runs ordered by digest and place, where each digest starts, ords and text hashes by run)."""
    ords = rows.column("ord").to_numpy()[row]
    text = np.array([int.from_bytes(s[:8], "big", signed=True) for s in rows.column("sha").to_pylist()], np.int64)[row]
    order = np.lexsort((first, text, ords, low, high))
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(order)])
    return order, starts, ords, text


SENT = "block long, part int, high binary, low binary, ords binary, texts binary, firsts binary"
COLUMNS = ["no", "ord", "doc_id", "sha", "text"]


def send(blocks: DataFrame, rule: tuple, part_bits: int) -> DataFrame:
    """Per block and part, packed and in order: each digest and its first place in the block."""

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        _, _, row, first, _, high, low = _block_spans(rows, rule)
        order, starts, ords, text = _leaders(rows, row, first, high, low)
        lead = order[starts]
        cols = [high[lead], low[lead], ords[lead], text[lead], first[lead].astype(np.int32)]
        part = (cols[0] >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(lead), np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        ends = [*cuts[1:].tolist(), len(part)]
        packed = [pa.array([c[s:e].tobytes() for s, e in zip(cuts.tolist(), ends, strict=False)], pa.binary()) for c in cols]
        block = pa.array([rows.column("block")[0].as_py()] * len(cuts), pa.int64())
        return pa.table([block, pa.array(part[cuts].astype(np.int32)), *packed], [c.split()[0] for c in SENT.split(", ")])

    return with_blocks(blocks, blocks.select("block").where("false"), ["no", "ord", "sha", "text"], work, SENT)


def judge(sent: DataFrame) -> DataFrame:
    """(block, part, marks): a byte per digest sent: 1 if another block has the first place. Nothing for all 0."""

    def run(t: pa.Table) -> pa.Table:
        kinds = {"high": np.uint64, "low": np.uint64, "ords": np.int64, "texts": np.int64, "firsts": np.int32}
        high, low, ords, texts, firsts = (np.concatenate([np.frombuffer(b.as_buffer(), k) for b in t.column(c)]) for c, k in kinds.items())
        sizes = np.array([len(b.as_buffer()) // 8 for b in t.column("high")])
        order = np.lexsort((firsts, texts, ords, low, high))
        new = np.r_[True, (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])]
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        marks = np.empty(len(order), np.uint8)
        marks[order] = (ords[order] != ords[lead]) | (texts[order] != texts[lead]) | (firsts[order] != firsts[lead])
        parts = np.split(marks, np.cumsum(sizes)[:-1])
        some = np.array([k for k, p in enumerate(parts) if p.any()], np.int64)
        return pa.table([t.column("block").take(some), t.column("part").take(some), pa.array([parts[k].tobytes() for k in some.tolist()], pa.binary())], ["block", "part", "marks"])

    return sent.groupBy("part").applyInArrow(run, "block long, part int, marks binary")


def _strip(parts: list[str], gone: np.ndarray) -> tuple[str, int, int]:
    """(what is left, sentences removed, maximal runs of removed sentences)."""
    kept = "".join(p for p, g in zip(parts, gone, strict=True) if not g)
    return kept, int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())


RESULT = "doc_id long, text binary, n_sentences long, n_removed long, n_spans long"


def dedup_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, block_bytes: int = 8 << 20, min_words: int = 0, long_words: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, text, n_sentences, n_removed, n_spans), text without the repeated sentences.

    n_removed counts sentences, n_spans maximal runs of removed ones. Null texts stay null with no sentences; empty and
    wordless texts, and those of fewer than ``span`` sentences, are left alone, unless ``min_words`` and ``long_words`` (``run_ends``) say otherwise. A very long text is a block of its own.
    Rows with equal id and text, repeated rows too, are one document: each keeps what is first in it. Of equal ids (null
    comes last) with different texts, the text of the least SHA-256 counts as first. No rows: no result rows; further
    columns are ignored, whatever their names."""
    blocks, total = text_blocks(docs, id_col, text_col, block_bytes)
    part_bits, rule = part_bits_of(total), (span, min_words, long_words)

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        texts, solids, row, first, end, high, low = _block_spans(rows, rule)
        order, starts, ords, text = _leaders(rows, row, first, high, low)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        lead = order[starts][of] if len(order) else order
        again = (ords[order] != ords[lead]) | (text[order] != text[lead]) | (first[order] != first[lead])
        part = (high[order[starts]] >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(starts), np.int64)
        marks = np.zeros(len(starts), bool)
        for p, m in zip(found.column("part").to_pylist(), found.column("marks").to_pylist(), strict=True):
            at = np.searchsorted(part, p)
            marks[at : at + len(m)] = np.frombuffer(m, np.uint8) > 0
        hit = order[again | marks[of]]
        gone = [np.zeros(len(p), bool) for p in texts]
        for r, k, e in zip(row[hit].tolist(), first[hit].tolist(), end[hit].tolist(), strict=True):
            gone[r][solids[r][k] : solids[r][e - 1] + 1] = True
        out = [_strip(p, g) for p, g in zip(texts, gone, strict=True)]
        kept, removed, runs = zip(*out, strict=True)
        null = rows.column("text").is_null().to_pylist()
        kept = pa.array([None if n else t.encode() for n, t in zip(null, kept, strict=True)], pa.binary())
        cols = [rows.column("doc_id"), kept, pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
        return pa.table(cols, [c.split()[0] for c in RESULT.split(", ")])

    out = with_blocks(blocks, judge(send(blocks, rule, part_bits)), COLUMNS, work, RESULT)
    return out.withColumn("text", out["text"].cast("string"))
