"""Suffix and common-prefix arrays by induced sorting with bucket queues that spill to disk.

The order of the leftmost S-type suffixes, found by recursion on their names, induces that of all L-type
suffixes in one ascending pass and of all S-type suffixes in one descending pass. Each pass is a priority queue
whose keys, the first characters, only grow (or only fall): it keeps one run of tuples (suffix, common prefix
with its neighbour) per character, in the order of arrival. Tuples beyond ``memory_bytes`` go to a temporary
file and come back when their character's turn comes. Common prefixes are carried along: a suffix induced
from another shares with its neighbour in the queue one character more than the least value passed on the
way between the two that induced them. They are capped at ``cap``. What the first pass found waits in such runs
too, and arrays of the text's length that exceed the limit are mapped files, so a text may be far longer than
memory.
"""

from __future__ import annotations

import tempfile

import numpy as np


class BucketQueue:
    """A monotone priority queue of tuples (position, common prefix), first in first out under equal keys."""

    def __init__(self, memory_bytes: int):
        self.memory_bytes, self.held = memory_bytes, 0
        self.runs: dict[int, list] = {}
        self.file = None

    def push(self, keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Tuples sorted by key, in order of arrival under each key."""
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            self.runs.setdefault(int(keys[s]), []).append((positions[s:e].copy(), prefixes[s:e].copy()))
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.memory_bytes:
            self._spill()

    def put(self, key: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Tuples of one key."""
        self.push(np.full(len(positions), key), positions, prefixes)

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115  closed with the queue
        self.file.seek(0, 2)
        for run in self.runs.values():
            for i, part in enumerate(run):
                if len(part) == 2:
                    at = self.file.tell()
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    run[i] = (at, len(part[0]), part[0].dtype, part[1].dtype)
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples under a key that have come so far."""
        run = self.runs.pop(key, None)
        if run is None:
            return None
        parts = []
        for part in run:
            if len(part) == 4:
                at, n, a, b = part
                self.file.seek(at)
                parts.append((np.frombuffer(self.file.read(n * a.itemsize), a), np.frombuffer(self.file.read(n * b.itemsize), b)))
            else:
                parts.append(part)
                self.held -= part[0].nbytes + part[1].nbytes
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Passed:
    """For each target key, the least common prefix passed in the stream since the last push to it."""

    def __init__(self, n_keys: int, cap: int):
        self.least = np.zeros(n_keys, np.uint8)
        self.cap = cap

    def induce(self, prefixes: np.ndarray, sources: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes a stretch of the stream by its common prefixes; ``sources`` (ascending places in it) push under
        ``keys``. Returns the stable order of the sources by key and the common prefixes of what they push."""
        n = len(prefixes)
        order = np.argsort(keys, kind="stable")
        at, key = sources[order], keys[order]
        table = [prefixes]  # table[k][i]: least of 2**k from i on
        while 2 << (len(table) - 1) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(a), np.uint8)
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                m = level == k
                out[m] = np.minimum(table[k][a[m]], table[k][b[m] - (1 << k)])
            return out

        out = np.empty(0, np.uint8)
        if len(at):
            first = np.r_[True, key[1:] != key[:-1]]
            out = least(np.where(first, 0, np.r_[0, at[:-1] + 1]), at + 1)
            out[first] = np.minimum(out[first], self.least[key[first]])
            out = np.minimum(out.astype(np.int16) + 1, self.cap).astype(np.uint8)
        np.minimum(self.least, prefixes.min(), out=self.least)
        if len(at):
            last = np.r_[key[1:] != key[:-1], True]
            rest, inside = np.full(int(last.sum()), 255, np.uint8), at[last] + 1 < n
            rest[inside] = least(at[last][inside] + 1, np.full(int(inside.sum()), n))
            self.least[key[last]] = rest
        return order, out


LANES = np.array([1 << 16, 1 << 32, 1 << 48], np.uint64)
AT_ONCE = 1 << 12  # of more pairs, four characters are compared at once


def _by_fours(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """``common_prefix`` of characters of two bytes, none of them negative."""
    padded = np.concatenate([text, np.full(4, -1, np.int16)])  # differs from all characters, as a and b differ
    four = np.ndarray(len(text) + 1, "<u8", padded, strides=(2,))  # the four characters from each place on
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        apart = four[a[live] + out[live]] ^ four[b[live] + out[live]]
        low = apart & (~apart + np.uint64(1))  # the lowest bit that differs, 0 if none does
        out[live] += np.where(low == 0, 4, np.searchsorted(LANES, low, "right"))
        live = live[(low == 0) & (out[live] < cap)]
    out = np.minimum(out, cap)
    return out.astype(np.uint8) if cap < 256 else out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to cap; the text's end differs from all."""
    if len(a) > AT_ONCE and text.dtype == np.int16:
        return _by_fours(text, a, b, cap)
    out = np.zeros(len(a), np.int64)
    live, n = np.arange(len(a)), len(text)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n) & (out[live] < cap)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[text[x] == text[y]]
        out[live] += 1
    return out.astype(np.uint8) if cap < 256 else out


def room(n: int, kind, memory_bytes: int) -> np.ndarray:
    """An array; a mapped scratch file beyond the limit."""
    if n * np.dtype(kind).itemsize <= memory_bytes:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=n)


def types(text: np.ndarray, memory_bytes: int = 1 << 30, step: int = 1 << 20) -> np.ndarray:
    """True for S-type: smaller than the next suffix. The end counts as smaller than all, so the last is L-type."""
    n = len(text)
    up = room(n, bool, memory_bytes)
    after = False  # of the place behind the piece
    for s in range((n - 1) // step * step, -1, -step):
        part = np.asarray(text[s : s + step + 1])
        m = min(step, n - s)
        differs = np.flatnonzero(part[:-1] != part[1:])
        nearest = np.searchsorted(differs, np.arange(m))  # first place from here on where the next one differs
        has = nearest < len(differs)
        piece = np.full(m, after)
        d = differs[nearest[has]]
        piece[has] = part[d] < part[d + 1]
        up[s : s + m] = piece
        after = bool(piece[0])
    return up


def _pop_all(queue: BucketQueue, key: int, induce) -> tuple[np.ndarray, np.ndarray]:
    """All tuples of a key, those that they push under the key itself included. Each stretch is passed to ``induce``
    with the first tuple's common prefix set to 0, as what came before starts with another character."""
    got = []
    while (more := queue.pop(key)) is not None:
        positions, values = more[0].astype(np.int64), more[1].copy()
        if not got:
            values[0] = 0
        got.append((positions, values))
        induce(positions, values)
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _passes(text: np.ndarray, small: np.ndarray, lms: np.ndarray, prefixes: np.ndarray | None, cap: int, memory_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, from the leftmost S-type ones in order, with common prefixes.

    ``prefixes``: of each of ``lms`` with the one before; None if only the order is asked for, prefixes then are 0."""
    n, n_keys = len(text), int(text.max()) + 1
    dtype = np.int32 if n < 2**31 else np.int64

    def pusher(queue: BucketQueue, wanted: np.ndarray):
        passed = _Passed(n_keys, cap)

        def push(positions: np.ndarray, values: np.ndarray) -> None:
            ok = np.flatnonzero((positions > 0) & wanted[positions - 1])
            before = positions[ok] - 1
            keys = text[before]
            if prefixes is None:
                order = np.argsort(keys, kind="stable")
                got = np.zeros(len(order), np.uint8)
            else:
                order, got = passed.induce(values, ok, keys)
            queue.push(keys[order], before[order].astype(dtype), got)

        return push

    present = np.unique(text)
    lms_at = dict(zip(present.tolist(), zip(np.searchsorted(text[lms], present, "left"), np.searchsorted(text[lms], present, "right"), strict=True), strict=True))
    ascending = BucketQueue(memory_bytes)
    push = pusher(ascending, ~small)
    push(np.array([n]), np.zeros(1, np.uint8))  # the text's end, before all suffixes
    ells = BucketQueue(memory_bytes)
    for c in present.tolist():
        positions, values = _pop_all(ascending, c, push)
        ells.put(c, positions.astype(dtype), values)
        s, e = lms_at[c]
        if e > s:
            values = np.zeros(e - s, np.uint8) if prefixes is None else prefixes[s:e].copy()
            values[0] = common_prefix(text, positions[-1:], lms[s : s + 1], cap)[0] if len(positions) and prefixes is not None else 0
            push(lms[s:e], values)
    ascending.close()
    descending = BucketQueue(memory_bytes)
    push = pusher(descending, small)
    order, prefix, end = room(n, dtype, memory_bytes), room(n, np.uint8, memory_bytes), n
    for c in present[::-1].tolist():
        positions, values = ells.pop(c) or (np.empty(0, dtype), np.empty(0, np.uint8))
        values = values.copy()
        falling, shared = _pop_all(descending, c, push)
        edge = np.zeros(1, np.uint8)  # of the largest L-type suffix with the smallest S-type one
        if len(positions) and len(falling) and prefixes is not None:
            edge = common_prefix(text, positions[-1:], falling[-1:], cap)
        if len(positions):
            push(positions[::-1], np.r_[edge, values[1:][::-1]])
        if len(falling):
            positions, values = np.r_[positions, falling[::-1]], np.r_[values, edge, shared[1:][::-1]]
        values[0] = 0
        at, end = end - len(positions), end - len(positions)
        order[at : at + len(positions)], prefix[at : at + len(positions)] = positions, values
    ells.close()
    descending.close()
    return order, prefix


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string that fits in memory."""
    n = len(names)
    rank, step = np.unique(names, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank, step = new, step * 2
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step = min(step, n)


def suffix_order(text: np.ndarray, cap: int = 64, memory_bytes: int = 64 << 20, base: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before, at most ``cap`` < 255) of an integer text.

    The recursion ends at strings of ``base`` names, which are sorted in memory by doubling."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    small = types(text, memory_bytes)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        by_first = lms[np.argsort(text[lms], kind="stable")]
        # Any order under equal first characters sorts the substrings between leftmost S-type places.
        order, _ = _passes(text, small, by_first, None, cap, memory_bytes)
        is_lms = room(n, bool, memory_bytes)
        is_lms[:] = False
        is_lms[lms] = True
        sorted_lms = order[is_lms[order]]
        length = room(n, np.int64, memory_bytes)
        length[lms] = np.r_[np.diff(lms) + 1, n - lms[-1] + 1]
        a, b = sorted_lms[:-1], sorted_lms[1:]
        same = length[a] == length[b]
        if same.any():
            longest = int(length[lms].max())
            same[same] = common_prefix(text, a[same], b[same], longest).astype(np.int64) >= length[a[same]]
        name = np.r_[0, np.cumsum(~same)]
        names = room(n, np.int64, memory_bytes)
        names[sorted_lms] = name
        if name[-1] == len(lms) - 1:
            lms = sorted_lms
        else:
            reduced = names[lms]
            inner = _by_doubling(reduced) if len(reduced) <= base else suffix_order(reduced, cap, memory_bytes, base)[0]
            lms = lms[inner]
    prefixes = np.zeros(len(lms), np.uint8)
    if len(lms) > 1:
        prefixes[1:] = common_prefix(text, lms[:-1], lms[1:], cap)
    return _passes(text, small, lms, prefixes, cap, memory_bytes)
