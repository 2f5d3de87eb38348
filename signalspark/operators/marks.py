"""Extrema and zero crossings of long series, settled by stretches of the order in Arrow kernels.

A series is read twice, whatever is asked for: each stretch first tells what its ends are like (a row a stretch), and is then
settled with what the other stretches of its series tell it; both go over one shuffle. Only series of several stretches have
anything to tell, so the rows between are as many as their stretches. Values are compared as doubles, NaN above all others; a
null is equal to nothing. The order is numeric and not null. Of a plateau over several stretches the middle counts as a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signalspark.operators.scans import STRETCH

#: The ends of a stretch: first and last place; number of runs of equal values; value and last place of the first run and value of
#: the second; value and first place of the last run and value of the one before; first and last extremum inside; crossings.
ENDS = ("i0", "i1", "runs", "head", "head_last", "second", "tail", "tail_first", "before_tail", "mark0", "kind0", "mark1", "kind1", "cross0", "cross1")
#: What lies left of a stretch: its last run and the value before that; the last extremum and crossing known; the first place. So right.
LEFT = ("l_value", "l_first", "l_last", "l_beyond", "l_mark", "l_kind", "l_cross", "low")
RIGHT = ("r_value", "r_first", "r_last", "r_beyond", "r_mark", "r_kind", "r_cross", "high")
NOTHING = dict.fromkeys((*LEFT, *RIGHT))
#: An extremum: middle, value, kind (1: peak), whether the middle is a row; the crossings around it; its extent (up to the nearer of
#: crossing and extremum, or the series' end) and the sum of the values in it, null and ``open`` if other stretches have part of it.
MARKS = {"at": "double", "height": "double", "kind": "int", "here": "boolean", "prev_cross": "double", "next_cross": "double", "start": "double", "stop": "double", "area": "double", "open": "boolean"}


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _kind(value: float | None, before: float | None, after: float | None) -> int:
    """1 for a peak, -1 for a trough."""
    if value is None or before is None or after is None:
        return 0
    up = [bool(_above(value, v)) for v in (before, after)]
    down = [bool(_above(v, value)) for v in (before, after)]
    return 1 if all(up) else -1 if all(down) else 0


def _same(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and (a == b or (a != a and b != b))


def _crosses(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and bool(_above(a, 0.0)) != bool(_above(b, 0.0))


class _Stretch:
    """Rows of a stretch in order, its runs of equal values (first and last row) and the rows before a crossing."""

    def __init__(self, part: pa.Table):
        i, x = (part.column(c).to_numpy() for c in ("_i", "_x"))
        self.at = np.argsort(i, kind="stable")
        self.i, self.x = i[self.at], x[self.at].astype(float)
        self.ok = part.column("_x").is_valid().to_numpy()[self.at]
        x, ok = self.x, self.ok
        there = ok[1:] & ok[:-1]
        same = (x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))
        self.first = np.flatnonzero(np.r_[True, ~(same & there)])
        self.last = np.append(self.first[1:], len(x)) - 1
        up = _above(x, 0.0)
        self.cross = self.i[:-1][(up[1:] != up[:-1]) & there]

    def value(self, run: int) -> float | None:
        k = self.first[run]
        return float(self.x[k]) if self.ok[k] else None

    def kinds(self, before: float | None, after: float | None) -> np.ndarray:
        """Kind of each run, with the values on both sides of the stretch."""
        v, ok = self.x[self.first], self.ok[self.first]
        ends = [(np.nan if s is None else s, s is not None) for s in (before, after)]
        v, ok = np.r_[ends[0][0], v, ends[1][0]], np.r_[ends[0][1], ok, ends[1][1]]
        sure = ok[1:-1] & ok[:-2] & ok[2:]
        peak = sure & _above(v[1:-1], v[:-2]) & _above(v[1:-1], v[2:])
        trough = sure & _above(v[:-2], v[1:-1]) & _above(v[2:], v[1:-1])
        return peak.astype(int) - trough


def _ends(s: _Stretch) -> dict:
    n = len(s.first)
    out = dict.fromkeys(ENDS) | {"i0": s.i[0], "i1": s.i[-1], "runs": n, "head": s.value(0), "head_last": s.i[s.last[0]], "tail": s.value(n - 1), "tail_first": s.i[s.first[-1]]}
    if n > 1:
        out |= {"second": s.value(1), "before_tail": s.value(n - 2)}
    kinds = s.kinds(None, None)
    inside = np.flatnonzero(kinds)
    for name, k in (("0", inside[:1]), ("1", inside[-1:])):
        if len(k):
            out |= {f"mark{name}": np.floor((s.i[s.first[k[0]]] + s.i[s.last[k[0]]]) / 2), f"kind{name}": kinds[k[0]]}
    if len(s.cross):
        out |= {"cross0": s.cross[0], "cross1": s.cross[-1]}
    return {k: None if v is None else float(v) for k, v in out.items()}


def _neighbours(rows: list[dict]) -> list[dict]:
    """What each stretch of a series gets, from the ends of all of them in order."""
    out = [dict(NOTHING) for _ in rows]
    for side, names, step in (("l", LEFT[:-1], 1), ("r", RIGHT[:-1], -1)):
        near, far = ("head", "tail") if step > 0 else ("tail", "head")
        value = first = last = beyond = mark = kind = cross = None

        def settle(after: float | None):
            nonlocal mark, kind
            if k := _kind(value, beyond, after):
                mark, kind = float(np.floor((first + last) / 2)), k

        for r, its in list(zip(rows, out, strict=True))[::step]:
            its.update(zip(names, (value, first, last, beyond, mark, kind, cross), strict=True))
            i0, i1 = r["i0"], r["i1"]
            known = first is not None
            if known and _crosses(value, r[near]):
                cross = last if step > 0 else i1
            if (own := r["cross1" if step > 0 else "cross0"]) is not None:
                cross = own
            end = i1 if r["runs"] == 1 else r["head_last"]
            begin = i0 if r["runs"] == 1 else r["tail_first"]
            if known and _same(value, r[near]):
                first, last = (first, end) if step > 0 else (begin, last)
            else:
                settle(r[near])
                value, beyond = r[near], value if known else None
                first, last = (i0, end) if step > 0 else (begin, i1)
            if r["runs"] > 1:
                settle(r["second" if step > 0 else "before_tail"])
                if (own := r["mark1" if step > 0 else "mark0"]) is not None:
                    mark, kind = own, int(r["kind1" if step > 0 else "kind0"])
                value = r[far]
                first, last, beyond = (r["tail_first"], i1, r["before_tail"]) if step > 0 else (i0, r["head_last"], r["second"])
    for its in out:
        its["low"], its["high"] = rows[0]["i0"], rows[-1]["i1"]
    return out


def _settled(s: _Stretch, c: dict):
    """((first, last, middle, value, kind) of the runs that are extrema and start in the stretch, middles and kinds of the extrema
    around the rows in order, crossings around the rows in order). The middles without a row are left out of the last two but one."""
    n, i = len(s.first), s.i
    a, b = i[s.first], i[s.last]
    left, right = c["l_first"] is not None, c["r_first"] is not None
    joined = left and _same(c["l_value"], s.value(0)), right and _same(c["r_value"], s.value(n - 1))
    before, after = (c["l_beyond"] if joined[0] else c["l_value"] if left else None), (c["r_beyond"] if joined[1] else c["r_value"] if right else None)
    if joined[0]:
        a[0] = c["l_first"]
    if joined[1]:
        b[-1] = c["r_last"]
    kinds = s.kinds(before, after)
    middle = np.floor((a + b) / 2)
    k = np.minimum(np.searchsorted(i, middle), len(i) - 1)
    here = (i[k] == middle) | (a < i[0]) | (b > i[-1])
    marks, crosses = [], list(s.cross)
    if c["l_mark"] is not None:
        marks.append((c["l_mark"], int(c["l_kind"])))
    if left and not joined[0] and (m := _kind(c["l_value"], c["l_beyond"], s.value(0))):
        marks.append((np.floor((c["l_first"] + c["l_last"]) / 2), m))
    done = np.flatnonzero(kinds)
    behind = []
    if right and not joined[1] and (m := _kind(c["r_value"], s.value(n - 1), c["r_beyond"])):
        behind.append((np.floor((c["r_first"] + c["r_last"]) / 2), m))
    if c["r_mark"] is not None:
        behind.append((c["r_mark"], int(c["r_kind"])))
    at = np.r_[[m for m, _ in marks], middle[done], [m for m, _ in behind]]
    kind = np.r_[[m for _, m in marks], kinds[done], [m for _, m in behind]].astype(int)
    real = np.r_[np.ones(len(marks), bool), here[done], np.ones(len(behind), bool)]
    if left and _crosses(c["l_value"], s.value(0)):
        crosses.insert(0, c["l_last"])
    elif c["l_cross"] is not None:
        crosses.insert(0, c["l_cross"])
    if right and _crosses(s.value(n - 1), c["r_value"]):
        crosses.append(i[-1])
    elif c["r_cross"] is not None:
        crosses.append(c["r_cross"])
    own = done[1:] if joined[0] and len(done) and done[0] == 0 else done
    return (a[own], b[own], middle[own], s.x[s.first[own]], kinds[own], here[own]), (at, kind, real), np.array(crosses, float)


def _near(places: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places by number, NaN outside."""
    return np.r_[places, np.nan][np.where((k < 0) | (k >= len(places)), len(places), k)]


def _mark_columns(s: _Stretch, c: dict) -> list[pa.Array]:
    (a, b, at, height, kind, here), (around, _, _), crosses = _settled(s, c)
    low, high = (s.i[0], s.i[-1]) if c["low"] is None else (c["low"], c["high"])
    prev, after = _near(crosses, np.searchsorted(crosses, a) - 1), _near(crosses, np.searchsorted(crosses, b))
    start = np.fmax(np.where(np.isnan(prev), low, prev), np.nan_to_num(_near(around, np.searchsorted(around, at) - 1), nan=low))
    stop = np.fmin(np.where(np.isnan(after), high, after), np.nan_to_num(_near(around, np.searchsorted(around, at, "right")), nan=high))
    open_ = (start < s.i[0]) | (stop > s.i[-1])
    p, q = np.searchsorted(s.i, start, "right"), np.searchsorted(s.i, stop, "right")
    if np.isfinite(s.x[s.ok]).all():
        sums = np.r_[0.0, np.cumsum(np.where(s.ok, s.x, 0.0))]
        area = sums[q] - sums[p]
    else:
        area = np.array([s.x[u:v][s.ok[u:v]].sum() for u, v in zip(p, q, strict=True)], float)
    some = np.r_[0, np.cumsum(s.ok)]
    arrays = [pa.array(at), pa.array(height), pa.array(kind.astype(np.int32)), pa.array(here)]
    arrays += [pa.array(v, mask=np.isnan(v)) for v in (prev, after)]
    return [*arrays, pa.array(start), pa.array(stop), pa.array(area, mask=open_ | (some[q] == some[p])), pa.array(open_)]


def _phases(s: _Stretch, c: dict) -> pa.Array:
    _, (at, kind, real), _ = _settled(s, c)
    at, kind = at[real], kind[real]
    k = np.searchsorted(at, s.i, "right") - 1
    here, there = _near(at, k), _near(at, np.where(k < 0, -1, k + 1))
    base = np.r_[np.where(kind > 0, 0.5, 0.0), 0.0][k]
    phase = base + 0.5 * (s.i - here) / (there - here)
    return pa.array(phase, mask=np.isnan(here) | np.isnan(there))


def _by_stretches(df: DataFrame, keys: list[str], order: str, value: str, kept: list[str], made: dict[str, str], columns, size: int, several_only: bool = False) -> DataFrame:
    """(kept columns by row or else the keys, ``made``): ``columns(stretch, what lies around it)`` of each stretch, or only of those of
    series of several."""
    rows = df.select(*dict.fromkeys([*keys, *kept]), F.col(order).cast("double").alias("_i"), F.col(value).cast("double").alias("_x"), F.floor(F.col(order) / size).cast("long").alias("_piece"))
    group = [*keys, "_piece"]
    kinds = [df.schema[k] for k in keys]
    doubles = lambda names: [T.StructField(c, T.DoubleType()) for c in names]
    place = [*kinds, T.StructField("_piece", T.LongType())]
    tell, given = T.StructType([*place, *doubles(ENDS)]), T.StructType([*place, *doubles(NOTHING)])
    out = T.StructType([*([df.schema[c] for c in kept] or kinds), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in made.items())])
    told, gives, result = to_arrow_schema(tell), to_arrow_schema(given), to_arrow_schema(out)
    names = [k.name for k in place]

    def ends(key, part):
        return pa.Table.from_pylist([dict(zip(names, (k.as_py() for k in key), strict=True)) | _ends(_Stretch(part))], told)

    def around(key, part):
        part = part.sort_by("_piece").to_pylist()
        return pa.Table.from_pylist([{c: r[c] for c in names} | n for r, n in zip(part, _neighbours(part), strict=True)], gives)

    def settle(key, part, its):
        if not part.num_rows or (several_only and not its.num_rows):
            return result.empty_table()
        s = _Stretch(part)
        found = columns(s, its.select(list(NOTHING)).to_pylist()[0] if its.num_rows else NOTHING)
        if kept:
            heads = part.select(kept).take(pa.array(s.at)).columns
        else:
            heads = [pa.repeat(pa.scalar(k.as_py(), result.field(j).type), len(found[0])) for j, k in enumerate(key[:-1])]
        return pa.Table.from_arrays([*heads, *found], schema=result)

    several = rows.groupBy(*group).applyInArrow(ends, tell).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")
    sides = several.groupBy(*keys).applyInArrow(around, given)
    sides = sides.select(*(F.col(k).alias(f"_of {k}") for k in group), *NOTHING)
    return rows.groupBy(*group).cogroup(sides.groupBy(*(f"_of {k}" for k in group))).applyInArrow(settle, out)


def marks(df: DataFrame, keys: list[str], order: str = "i", value: str = "x", size: int = STRETCH, several_only: bool = False) -> DataFrame:
    """(keys, columns of MARKS): the extrema of each series, one row for a plateau; or only those of series of several stretches."""
    return _by_stretches(df, keys, order, value, [], MARKS, _mark_columns, size, several_only)


def long_rows(df: DataFrame, keys: list[str], order: str = "i", value: str = "x", size: int = STRETCH) -> DataFrame:
    """(keys, at, height): the rows of series of several stretches."""
    columns = {k: MARKS[k] for k in ("at", "height")}
    return _by_stretches(df, keys, order, value, [], columns, lambda s, c: [pa.array(s.i), pa.array(s.x, mask=~s.ok)], size, True)


def phases(df: DataFrame, keys: list[str], order: str = "i", value: str = "x", size: int = STRETCH) -> DataFrame:
    """All rows with ``phase``: 0 at troughs, 0.5 at peaks, 1 at the next trough; null outside the first and last extremum."""
    return _by_stretches(df, keys, order, value, df.columns, {"phase": "double"}, lambda s, c: [_phases(s, c)], size)
