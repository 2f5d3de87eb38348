"""Substring dedup: bytes covered by long strings that start in an earlier document too.

Texts are stored once, in blocks of bounded size that are bucketed by block, so that what is found out about a block
comes back to its texts without moving them again. Then

1. exact copies are told by digest and leave the work to their first document;
2. every ``length``-byte window belongs to the ``GRAM``-byte string in it with the least hash, its anchor, so equal
   windows have equal anchors wherever they stand. Blocks send the hashes of their anchors to parts of the hash range,
   four bytes each; the part replies which occur more than once in the corpus. This is an exact join, not a filter;
3. stretches of windows with a repeated anchor go as snippets to shards chosen by anchor, where all copies of a
   window meet. The snippets of a shard are sorted by induced sorting (``induced_sort``), with queues on disk beyond
   a memory limit; suffixes that share ``length`` bytes with their neighbours are copies of one window, and the
   earliest document among them is the window's. Snippets that share no window with another one of their anchor, by
   hashes of whole windows, are left out of the sort;
4. shards reply to blocks with the ranges to remove.

A block sends a snippet once, for the first of its earliest rows that have it, however often it stands there. Rows of
later documents in the block need no answer: they lose the snippet to the block's own earliest one. Further places in
rows of that document follow the answer for the first. So a passage that very many documents share word for word brings
its shard an entry a block, not one a document; what a block knows by itself goes past the shards.

An anchor that occurs among very many different bytes, as at the end of a passage that many documents share and go
on from in their own ways, would bring one shard a snippet per document. Its stretches are cut into single windows,
each dealt by a hash of its own bytes: equal windows still meet, and no anchor's rows are unbounded.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.blocks import LAST, info, part_bits_of, text_blocks, with_blocks
from signalspark.llm.common import salted_join
from signalspark.llm.induced_sort import suffix_order

GRAM = 20
SEGMENT = 1 << 17  # bytes hashed at once, so that arrays stay in the cache; positions take 24 bits
HOT = 20_000  # an anchor with more different snippets than that is dealt by window
COMPARED_BYTES = 1 << 20  # bytes of snippets looked through at once


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings of a byte array."""
    n = len(data) - GRAM + 1
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty((len(data) // 8 + 1) * 8, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")[: len(eight) // 8]
        eight[k : k + 8 * len(part) : 8] = part
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += eight[GRAM - 8 : GRAM - 8 + n]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(keys) - width + 1], out[width - have :][: len(keys) - width + 1])
    return out


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end in ``data`` -> (first window, one past the last window, anchor hash, sum of the hashes
    of all GRAM-byte strings) of each stretch.

    ``ends``: where each text ends. Windows lie inside one text."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    n = len(data) - length + 1
    if n < 1:
        return none
    hashes = _gram_hashes(data)
    keys = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_least_in_windows(keys, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[ends[ends < n]] = True
    starts = np.flatnonzero(new)
    end = ends[np.searchsorted(ends, starts, "right")]
    # The last stretch of a text ends where its windows do.
    stops = np.minimum(np.append(starts[1:], n), end - length + 1)
    good = stops > starts
    starts, stops = starts[good], stops[good]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    return starts, stops, hashes[anchor[starts]], sums[stops + length - GRAM] - sums[starts]


def _segments(texts: list[bytes], length: int):
    """Groups of (text number, offset, bytes) of up to SEGMENT bytes; longer texts overlap so that no window is lost."""
    group, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t[at : at + SEGMENT + length - 1]
            if held + len(part) > SEGMENT and group:
                yield group
                group, held = [], 0
            if len(part) >= length:
                group.append((i, at, part))
                held += len(part)
    if group:
        yield group


def text_stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, offset of the first window, windows, anchor hash, content hash) of all stretches."""
    out = []
    for group in _segments(texts, length):
        ends = np.cumsum([len(g[2]) for g in group])
        first, stop, h, content = stretches(np.frombuffer(b"".join(g[2] for g in group), np.uint8), ends, length)
        part = np.searchsorted(ends, first, "right")
        shift = np.array([g[1] for g in group]) - np.r_[0, ends[:-1]]
        out.append((np.array([g[0] for g in group])[part], first + shift[part], stop - first, h, content))
    if not out:
        return (*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def copies(blocks: DataFrame) -> DataFrame:
    """(block, nos): rows whose whole text an earlier document has."""
    ids = blocks.select("block", "no", "ord", "sha")
    firsts = ids.groupBy("sha").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").drop("last")
    return salted_join(ids, firsts, ["sha"], ["block", "no"]).where("ord > first").groupBy("block").agg(F.collect_list("no").alias("nos"))


def _fresh_texts(rows: pa.Table, found: pa.Table) -> list[bytes]:
    """Texts by number, those of copies empty."""
    texts = [t or b"" for t in rows.column("text").to_pylist()]
    for nos in found.column("nos").to_pylist():
        for k in nos or ():
            texts[k] = b""
    return texts


# --- anchors ----------------------------------------------------------------------------------------------------
def _slots(h: np.ndarray, part_bits: int) -> np.ndarray:
    """An anchor's part and its 32 bits in the part, as one number.

    Anchors are least hashes, so their leading bits are mostly zero; mixed again, they fill all parts alike."""
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32 - part_bits)).astype(np.uint64)


def anchors(blocks: DataFrame, skipped: DataFrame, length: int, part_bits: int) -> DataFrame:
    """(block, part, slots, kinds): per block and part, the sorted anchors; kinds is 0 if the block has the anchor once,
    else the number of its different stretches there."""

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        _, _, _, h, content = text_stretches(_fresh_texts(rows, found), length)
        slot = _slots(h, part_bits)
        order = np.argsort(slot, kind="stable")
        slot, content = slot[order], content[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
        times = np.diff(np.append(starts, len(slot)))
        kinds = np.zeros(len(starts), np.int64)
        many = np.repeat(times > 1, times)
        if many.any():
            of, c = np.repeat(np.arange(len(starts)), times)[many], content[many]
            again = np.lexsort((c, of))
            of, c = of[again], c[again]
            np.add.at(kinds, of[np.r_[True, (of[1:] != of[:-1]) | (c[1:] != c[:-1])]], 1)
        slot = slot[starts]
        part = (slot >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        low, kinds = slot.astype(np.uint32), np.minimum(kinds, 65535).astype(np.uint16)
        spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True)) if len(cuts) else []
        cols = [
            pa.array([rows.column("block")[0].as_py()] * len(spans), pa.int64()),
            pa.array(part[cuts].astype(np.int32)),
            pa.array([low[s:e].tobytes() for s, e in spans], pa.binary()),
            pa.array([kinds[s:e].tobytes() for s, e in spans], pa.binary()),
        ]
        return pa.table(cols, ["block", "part", "slots", "kinds"])

    return with_blocks(blocks, skipped, ["no", "text"], work, "block long, part int, slots binary, kinds binary")


def repeated(sent: DataFrame) -> DataFrame:
    """(block, part, marks): a byte per anchor sent: 0 if it is nowhere else, 2 if hot, else 1. Nothing for all 0."""

    def run(t: pa.Table) -> pa.Table:
        slots = np.concatenate([np.frombuffer(b.as_buffer(), np.uint32) for b in t.column("slots")])
        kinds = np.concatenate([np.frombuffer(b.as_buffer(), np.uint16) for b in t.column("kinds")]).astype(np.int64)
        sizes = np.array([len(b.as_buffer()) // 4 for b in t.column("slots")])
        order = np.argsort(slots, kind="stable")
        starts = np.flatnonzero(np.r_[True, slots[order[1:]] != slots[order[:-1]]])
        times = np.diff(np.append(starts, len(order)))
        again = (times > 1) | (np.maximum.reduceat(kinds[order], starts) > 0)
        hot = np.add.reduceat(np.maximum(kinds[order], 1), starts) > HOT
        marks = np.empty(len(slots), np.uint8)
        marks[order] = np.repeat(np.where(again & hot, 2, again).astype(np.uint8), times)
        parts = np.split(marks, np.cumsum(sizes)[:-1])
        some = np.array([k for k, p in enumerate(parts) if p.any()], np.int64)
        return pa.table([t.column("block").take(some), t.column("part").take(some), pa.array([parts[k].tobytes() for k in some.tolist()], pa.binary())], ["block", "part", "marks"])

    return sent.groupBy("part").applyInArrow(run, "block long, part int, marks binary")


# --- snippets ---------------------------------------------------------------------------------------------------
def _marks_of(slot: np.ndarray, found: pa.Table) -> np.ndarray:
    """The mark of each stretch's anchor."""
    kinds, of = np.unique(slot, return_inverse=True)
    marks = np.zeros(len(kinds), np.uint8)
    for part, m in zip(found.column("part").to_pylist(), found.column("marks").to_pylist(), strict=True):
        if m is not None:
            at = np.searchsorted(kinds, np.uint64(part << 32))
            marks[at : at + len(m)] = np.frombuffer(m, np.uint8)
    return marks[of]


def _blob(a: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


SNIPPETS = "shard long, block long, anchors binary, sizes binary, bytes binary, nos binary, ords binary, offsets binary"
RANGES = "block long, nos array<int>, starts array<int>, stops array<int>, marks binary"


def snippets(blocks: DataFrame, found_out: DataFrame, length: int, part_bits: int, shards: int) -> DataFrame:
    """Per shard and block, packed: distinct snippets (anchor, size, bytes) and where the first of the block's earliest
    rows has them (row, its ord, offset).

    Under a negative shard, a block's own: places (row, offset, size) that lose their bytes to the block itself, and places
    that follow another one, with ``bytes`` the (row, offset) of that."""

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        texts, ords = _fresh_texts(rows, found), rows.column("ord").to_numpy()
        no, offset, size, h, _ = text_stretches(texts, length)
        mark = _marks_of(_slots(h, part_bits), found)
        keep, split = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
        ns = size[split]
        step = np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
        hot_no, hot_offset = np.repeat(no[split], ns), np.repeat(offset[split], ns) + step
        hot = [texts[k][o : o + length] for k, o in zip(hot_no.tolist(), hot_offset.tolist(), strict=True)]
        parts = [texts[k][o : o + s] for k, o, s in zip(no[keep].tolist(), offset[keep].tolist(), (size[keep] + length - 1).tolist(), strict=True)] + hot
        anchor = np.r_[h[keep], np.array([xxhash.xxh3_64_intdigest(p) for p in hot], np.uint64)]
        no, offset = np.r_[no[keep], hot_no], np.r_[offset[keep], hot_offset]
        table: dict = {}
        of = np.array([table.setdefault(p, len(table)) for p in parts], np.int64)
        kinds = list(table)
        sizes = np.array([len(k) for k in kinds], np.int64)
        row_ord = ords[no]
        least = np.full(len(kinds), LAST)
        np.minimum.at(least, of, row_ord)
        early = np.flatnonzero(row_ord == least[of])
        first = np.full(len(kinds), len(of))
        np.minimum.at(first, of[early], early)
        shard = ((anchor[first] >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        first, shard = first[by_shard], shard[by_shard]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
        out = [[] for _ in SNIPPETS.split(", ")]
        block = rows.column("block")[0].as_py()

        def send(*row):
            for c, v in zip(out, row, strict=True):
                c.append(v)

        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True) if len(cuts) else ():
            at = first[s:e]
            data = b"".join(kinds[k] for k in by_shard[s:e].tolist())
            send(int(shard[s]), block, _blob(anchor[at], np.uint64), _blob(sizes[of[at]], np.int32), data, _blob(no[at], np.int32), _blob(row_ord[at], np.int64), _blob(offset[at], np.int32))
        leader = np.empty(len(kinds), np.int64)
        leader[by_shard] = first
        late = np.flatnonzero(row_ord > least[of])
        follows = early[leader[of[early]] != early]
        for at, data in ((late, None), (follows, _blob(np.r_["0,2", no[leader[of[follows]]], offset[leader[of[follows]]]], np.int32))):
            if len(at):
                send(-1 - block, block, None, _blob(sizes[of[at]], np.int32), data, _blob(no[at], np.int32), None, _blob(offset[at], np.int32))
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in SNIPPETS.split(", ")])

    return with_blocks(blocks, found_out, ["no", "ord", "text"], work, SNIPPETS)


def earliest(parts: list[bytes], first: np.ndarray, length: int, memory_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first window, windows, earliest document) over the windows of each snippet, by sorting all suffixes: how
    many a snippet has, and those of all snippets one after another."""
    sizes = np.array([len(p) for p in parts])
    # Byte values count from 1; a zero ends each snippet, so no window reaches over it.
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
    ends, windows = np.cumsum(sizes + 1) - 1, sizes - length + 1
    text[ends] = 0
    edges = np.zeros(len(text), np.int8)
    edges[ends - sizes] = 1
    edges[ends - length + 1] = -1
    window = np.cumsum(edges, dtype=np.int8).view(bool)
    order, shared = suffix_order(text, length, memory_bytes)
    keep = window[order]
    group = np.cumsum(shared < length, dtype=np.int32 if len(text) < 2**31 else np.int64)[keep]
    order = order[keep]
    del shared, keep, text, edges
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low = np.minimum.reduceat(first[np.searchsorted(ends, order, "right")], starts)
    found = np.empty(len(order), np.int64)  # of each window, in the order of the snippets
    found[np.cumsum(window, dtype=group.dtype)[order] - 1] = np.repeat(low, np.diff(np.r_[starts, len(order)]))
    del order, group, starts, low
    bounds = np.r_[0, np.cumsum(windows)]
    new = np.r_[True, found[1:] != found[:-1]]
    new[bounds[:-1]] = True
    cuts = np.flatnonzero(new)
    per = np.diff(np.searchsorted(cuts, bounds))
    return per, cuts - np.repeat(bounds[:-1], per), np.diff(np.r_[cuts, len(found)]), found[cuts]


def comparable(parts: list[bytes], anchor: np.ndarray, length: int) -> np.ndarray:
    """Whether a snippet may share a window with another one of its anchor; it does but for hashes that clash.

    Equal windows have the same GRAM-byte strings at the same places, and so one sum of their hashes. Snippets are looked
    through anchor by anchor, so that no more than some anchors' windows are held."""
    out = np.zeros(len(parts), bool)
    if not parts:
        return out
    places = [*range(0, length - GRAM, GRAM), length - GRAM]
    order = np.argsort(anchor, kind="stable")
    sizes = np.array([len(p) for p in parts], np.int64)[order]
    before = np.cumsum(np.r_[0, sizes])
    first = np.flatnonzero(np.r_[True, np.diff(anchor[order]) != 0])  # of each anchor
    bounds = first[np.unique(np.searchsorted(before[first], np.arange(0, before[-1], COMPARED_BYTES)).clip(max=len(first) - 1))]
    for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(parts)], strict=True):
        of = order[s:e]
        h = _gram_hashes(np.frombuffer(b"".join([parts[k] for k in of.tolist()]), np.uint8))
        n = len(h) - (length - GRAM)
        key = np.zeros(n, np.uint64)
        for k, at in enumerate(places):
            key += h[at : at + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)
        windows = sizes[s:e] - length + 1
        owner = np.repeat(np.arange(e - s), windows)
        key = key[np.arange(len(owner)) + owner * (length - 1)]
        by_key = np.argsort(key)
        key = key[by_key]
        twice = np.flatnonzero(key[1:] == key[:-1])
        out[of[owner[by_key[twice]]]] = out[of[owner[by_key[twice + 1]]]] = True
    return out


def _settle(length: int, memory_bytes: int):
    """A shard's snippets -> (block, nos, starts, stops): ranges that an earlier document has too.

    What blocks know by themselves passes through; ``marks`` is set for places that follow another one."""
    names = [c.split()[0] for c in RANGES.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        arrays = lambda name, kind: [np.frombuffer(b.as_buffer(), kind) for b in t.column(name)]
        if t.column("shard")[0].as_py() < 0:
            nos, starts, sizes = (arrays(c, np.int32) for c in ("nos", "offsets", "sizes"))
            stops = [a + b for a, b in zip(starts, sizes, strict=True)]
            ints = pa.list_(pa.int32())
            return pa.table([t.column("block"), *(pa.array(v, ints) for v in (nos, starts, stops)), t.column("bytes")], names)
        table: dict = {}
        of, new = array("q"), array("q")
        for blob, sizes in zip(t.column("bytes"), arrays("sizes", np.int32), strict=True):
            data, at = blob.as_py(), 0
            for n in sizes.tolist():
                p = data[at : at + n]
                at += n
                k = table.get(p)
                if k is None:
                    k = table[p] = len(table)
                    new.append(len(of))
                of.append(k)
        parts, of = list(table), np.frombuffer(of, np.int64)
        anchor = np.concatenate(arrays("anchors", np.uint64))[np.frombuffer(new, np.int64)]
        del table
        ords, offsets, nos = np.concatenate(arrays("ords", np.int64)), np.concatenate(arrays("offsets", np.int32)), np.concatenate(arrays("nos", np.int32))
        block = np.repeat(t.column("block").to_numpy(), [len(b) // 4 for b in map(lambda s: s.as_buffer(), t.column("nos"))])
        first = np.full(len(parts), LAST)
        np.minimum.at(first, of, ords)
        # Runs of windows with one earliest document: of each snippet the whole, or what the sort says.
        _, kinds, together = np.unique(anchor, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(together[kinds] > 1)
        if len(mixed):
            mixed = mixed[comparable([parts[i] for i in mixed.tolist()], kinds[mixed], length)]
        begin, sizes = np.arange(len(parts)), np.ones(len(parts), np.int64)
        at, windows, low = np.zeros(len(parts), np.int64), np.array([len(p) - length + 1 for p in parts], np.int64), first
        if len(mixed):
            some = [parts[i] for i in mixed.tolist()]
            del parts
            sizes[mixed], *runs = earliest(some, first[mixed], length, memory_bytes)
            begin[mixed] = len(at) + np.cumsum(sizes[mixed]) - sizes[mixed]
            at, windows, low = (np.concatenate(v) for v in zip((at, windows, low), runs, strict=True))
        per = sizes[of]
        run_of = np.repeat(begin[of], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        owner = np.repeat(np.arange(len(of)), per)
        hit = low[run_of] < ords[owner]
        run_of, owner = run_of[hit], owner[hit]
        start = offsets[owner] + at[run_of]
        stop = start + windows[run_of] + length - 1
        by_block = np.argsort(block[owner], kind="stable")
        blocks = block[owner][by_block]
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]][: len(blocks)])
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(blocks)].astype(np.int32)), pa.array(v[by_block].astype(np.int32)))
        return pa.table([pa.array(blocks[cuts], pa.int64()), lists(nos[owner]), lists(start), lists(stop), pa.nulls(len(cuts), pa.binary())], names)

    return run


def strip(text: bytes, starts, stops) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, stops, -1)
    gone = np.cumsum(edges)[:-1] > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())


RESULT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def _followed(owner, start, stop, places, length: int):
    """Ranges of places (row, start, stop, row followed, start there) that lose the windows which the place followed loses.

    ``owner``, ``start``, ``stop``: ranges found, in order; one belongs to the place where its first window stands."""
    no, at, end, of_no, of_at = (v.astype(np.int64) for v in places)
    key = (owner.astype(np.int64) << 32) + start
    lo = np.searchsorted(key, (of_no << 32) + of_at)
    per = np.searchsorted(key, (of_no << 32) + of_at + (end - at - length + 1)) - lo
    found = np.repeat(lo, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    shift = np.repeat(at - of_at, per)
    return np.repeat(no, per), start[found] + shift, stop[found] + shift


def _strip_block(length: int):
    """Rows of a block without the ranges found; rows with ``nos`` but no ranges are copies."""

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        texts = [t or b"" for t in rows.column("text").to_pylist()]
        whole: set = set()
        owner, start, stop, following = [], [], [], []
        for nos, s, e, m in zip(*(found.column(c) for c in ("nos", "starts", "stops", "marks")), strict=True):
            if m.is_valid:
                following.append((*(v.values.to_numpy() for v in (nos, s, e)), *np.frombuffer(m.as_buffer(), np.int32).reshape(2, -1)))
            elif s.is_valid:
                for to, v in ((owner, nos), (start, s), (stop, e)):
                    to.append(v.values.to_numpy())
            else:
                whole.update(nos.as_py() or ())
        owner, start, stop = (np.concatenate(v) if v else np.empty(0, np.int32) for v in (owner, start, stop))
        order = np.lexsort((start, owner))
        owner, start, stop = owner[order], start[order], stop[order]
        if following:
            more = _followed(owner, start, stop, map(np.concatenate, zip(*following, strict=True)), length)
            owner, start, stop = (np.r_[a, b] for a, b in zip((owner, start, stop), more, strict=True))
            order = np.argsort(owner, kind="stable")
            owner, start, stop = owner[order], start[order], stop[order]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = []
        for k, t in enumerate(texts):
            a, b = bounds[k], bounds[k + 1]
            if k in whole and len(t) >= length:
                out.append((b"", len(t), 1))
            else:
                out.append(strip(t, start[a:b], stop[a:b]) if b > a else (t, 0, 0))
        kept, removed, spans = zip(*out, strict=True)
        cols = [rows.column("doc_id"), pa.array(kept, pa.binary()), rows.column("size"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        return pa.table(cols, [c.split()[0] for c in RESULT.split(", ")])

    return work


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard_bytes: int = 16 << 20, memory_bytes: int = 4 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: (doc_id, kept, n_bytes, n_removed, n_spans), kept the bytes that stay.

    A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id, by the
    texts as they came in. Rows of one id, repeated rows too, are one document to each other; a null id comes after
    all others. Null texts are empty; texts shorter than ``length`` stay whole; a text longer than ``block_bytes`` is
    a block of its own and is hashed in pieces that overlap. Ties: equal strings of the same document remove nothing.
    No rows: no result rows; further columns are ignored, whatever their names. ``shard_bytes``: bytes of text whose
    repeated snippets are sorted together; ``memory_bytes``: what the sort's queues hold before they go to disk."""
    blocks, total = text_blocks(docs, id_col, text_col, block_bytes)
    part_bits = part_bits_of(total)
    skipped = copies(blocks)
    marks = repeated(anchors(blocks, skipped, length, part_bits))
    shards = max(1, -(-total // shard_bytes))
    sent = snippets(blocks, info(skipped).unionByName(info(marks)), length, part_bits, shards)
    ranges = sent.groupBy("shard").applyInArrow(_settle(length, memory_bytes), RANGES)
    return with_blocks(blocks, info(skipped).unionByName(info(ranges)), ["no", "doc_id", "size", "text"], _strip_block(length), RESULT)
