"""Sequential grouping of intervals over many tasks.

Intervals are taken in order of (start, longest first). One joins the open group when it lies
inside the group's extent or shares at least half of their joint extent; otherwise it opens the next group. That
is a fold, but a group's course depends on its first interval alone: it ends at the first new
largest end that is too far out. So a part of the order can be folded without knowing what came before as soon as one
group start in it is certain: either no state of the open group could take the interval in, or all
states that could arrive lead to the same start. Only a part without such a start waits for the one before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ordered import PART, Layout

State = tuple[int, int]


def next_starts(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each interval as the first of a group, the position of the group behind it (the length where there is none).

    Only a larger end than all before can end a group, so a group climbs the chain of next larger ends. A step from
    r to t ends every group that starts before ``e[t] - 2 * e[r] + 2 * s[t]``; the first such step is found by doubling.
    """
    n = len(s)
    up = np.full(n + 1, n, np.int64)
    waiting: list[int] = []
    for t, end in enumerate(e.tolist()):
        while waiting and e[waiting[-1]] < end:
            up[waiting.pop()] = t
        waiting.append(t)
    least = np.iinfo(np.int64).min
    limit = np.full(n + 1, least, np.int64)
    has = np.flatnonzero(up[:n] < n)
    limit[has] = e[up[has]] - 2 * e[has] + 2 * s[up[has]]
    ups, limits = [up], [limit]
    while (ups[-1][:n] < n).any():
        a, m = ups[-1], limits[-1]
        ups.append(a[a])
        limits.append(np.maximum(m, m[a]))
    at = np.arange(n)
    for a, m in zip(reversed(ups), reversed(limits)):
        at = np.where(m[at] <= s, a[at], at)
    return up[at]


def certain_start(s: np.ndarray, e: np.ndarray, prev_start: np.ndarray, prev_end: np.ndarray) -> int | None:
    """A position where a group starts whatever group is open before the first interval, if there is one.

    ``prev_start`` and ``prev_end`` are the largest start and end of all earlier intervals. No open group begins
    later or reaches farther, so what such a group couldn't take in no group can.
    """
    sure = np.flatnonzero((e > prev_end) & (s > prev_start) & (2 * (prev_end - s) < e - prev_start))
    if len(sure):
        return int(sure[-1])
    lo, hi = int(prev_start[0]), int(prev_end[0])
    records, most = [], None
    for t, (a, z) in enumerate(zip(s.tolist(), e.tolist())):
        if most is None or z > most:  # no smaller end can be the first to leave
            records.append(t)
            most = z
        if z > hi:
            if 2 * (hi - a) < z - lo:
                break  # the last moment: every open group has ended by now
            hi = z
    else:
        return None
    following, n = next_starts(s, e), len(s)
    reach = sorted(set(records))
    heapq.heapify(reach)
    while len(reach) > 1:
        first = heapq.heappop(reach)
        if first == reach[0]:
            continue
        heapq.heappush(reach, int(following[first]))
        if reach[0] >= n:
            return None
    return reach[0] if reach[0] < n else None


def fold(s: list[int], e: list[int], state: State | None) -> tuple[list[int], State]:
    """1 where a group opens, and the extent of the last one. ``state`` is the extent of the group open before."""
    opens = []
    lo, hi = state if state is not None else (None, None)
    for a, z in zip(s, e):
        if lo is not None and (z <= hi or (a <= lo and z >= hi) or 2 * (min(hi, z) - a) >= max(hi, z) - lo > 0):
            opens.append(0)
            hi = max(hi, z)
        else:
            opens.append(1)
            lo, hi = a, z
    return opens, (lo, hi)


def _summary(key: str, entries: dict[int, State]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What is known of the group that is open behind one key's rows of one part."""

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["aa_start", "_neg_end"])
        part, first = int(pdf[PART].iloc[0]), pdf["_prev_end"].iloc[0]
        s, e = pdf["aa_start"].to_numpy(np.int64), pdf["aa_end"].to_numpy(np.int64)
        state = at = None
        if pd.isna(first):
            at = 0
        elif part in entries:
            at, state = 0, entries[part]
        else:
            at = certain_start(s, e, pdf["_prev_start"].to_numpy(np.int64), pdf["_prev_end"].to_numpy(np.int64))
        out = (None, None) if at is None else fold(s[at:].tolist(), e[at:].tolist(), state)[1]
        return pd.DataFrame({key: [pdf[key].iloc[0]], PART: [part], "lo": pd.array([out[0]], "Int64"), "hi": pd.array([out[1]], "Int64")})

    return summarise


def _entries(layout: Layout) -> dict[int, State]:
    """The group that is open where a part begins inside a key, for each such part.

    The rows of cut keys alone are looked at, one task per key and part; the driver sees two rows per part at
    most. Further rounds take only the parts in which no start was certain, with what is known of their predecessors.
    """
    if layout.cuts is None:
        return {}
    (key,) = layout.keys
    held = layout.cut_rows(layout.rows)
    schema = f"{key} {dict(held.dtypes)[key]}, {PART} int, lo long, hi long"

    def known(df: DataFrame, entries: dict[int, State]) -> list:
        return df.groupBy(key, PART).applyInPandas(_summary(key, entries), schema).collect()

    exits = {(r[key], r[PART]): (r["lo"], r["hi"]) for r in known(held, {})}
    order = sorted(exits, key=lambda k: k[1])
    while True:
        entries: dict[int, State] = {}
        last: dict = {}
        waiting = []
        for k, part in order:
            state = last.get(k)
            if k in last and state[0] is not None:
                entries[part] = state
                if exits[k, part][0] is None:
                    waiting.append(part)
            last[k] = exits[k, part]
        if not waiting:
            return entries
        open_ = held.filter(F.col(PART).isin(waiting))
        exits |= {(r[key], r[PART]): (r["lo"], r["hi"]) for r in known(open_, entries) if r["lo"] is not None}


def group_opens(layout: Layout) -> DataFrame:
    """The layout's intervals with ``_opens``, 1 at the first of each group.

    Its rows are in order of ``aa_start`` and ``_neg_end`` (the end, negative) under one key, with the largest earlier
    start and end as ``_prev_start`` and ``_prev_end``.
    """
    entries, (key,) = _entries(layout), layout.keys
    fields = ", ".join(f"{n} {t}" for n, t in layout.rows.dtypes) + ", _opens long"

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None  # the key and part of the row before, and the group that is open there
        for pdf in batches:
            parts, keys = pdf[PART].tolist(), pdf[key].tolist()
            s, e, later = pdf["aa_start"].tolist(), pdf["aa_end"].tolist(), pdf["_prev_end"].notna().tolist()
            here = list(zip(parts, (None if no else k for no, k in zip(pdf[key].isna().tolist(), keys))))
            began = [i for i, x in enumerate(here) if x != (here[i - 1] if i else at)]
            if not began or began[0]:
                began.insert(0, 0)
            opens: list[int] = []
            for a, z in zip(began, [*began[1:], len(here)]):
                if here[a] != at:
                    state = entries[parts[a]] if later[a] else None
                found, state = fold(s[a:z], e[a:z], state)
                opens += found
                at = here[a]
            yield pdf.assign(_opens=opens)

    # Sorted, a part runs through a task batch by batch; no part has to fit into Python's memory.
    return layout.rows.repartition(PART).sortWithinPartitions(PART, key, "aa_start", "_neg_end").mapInPandas(mark, fields)
