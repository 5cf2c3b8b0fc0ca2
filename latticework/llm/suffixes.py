"""Suffix arrays by Larsson-Sadakane refinement, common prefixes by Kasai's bound, merging by binary search; all in numpy."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from latticework.llm.anchors import eights


def suffix_array(data: np.ndarray, deepest: int | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order and ranks of all suffixes, and the ranks by their first 8, 16, ... bytes alone, up to `deepest` bytes: others aren't kept.

    Groups of suffixes alike in their first h bytes are split by the rank of what follows h bytes on, h doubling;
    suffixes already alone are left as they are.
    """
    n = len(data)
    head = eights(data).byteswap()
    order = np.argsort(head)
    new = np.concatenate([[True], head[order[1:]] != head[order[:-1]]]) if n else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    levels, h = [(8, rank.copy())], 8
    while True:
        size = np.diff(np.append(start, n))
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        suffix = order[at]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -1)
        both = rank[suffix] * (n + 1) + follow + 1
        sorted_ = np.argsort(both)
        order[at], both = suffix[sorted_], both[sorted_]
        split = np.concatenate([[True], both[1:] != both[:-1]])
        new = np.ones(n, bool)
        new[at] = split
        start = np.flatnonzero(new)
        rank = rank.copy()
        rank[order] = np.repeat(start, np.diff(np.append(start, n)))
        h *= 2
        if deepest is None or h <= deepest:
            levels.append((h, rank.copy()))
    return order, rank, levels


def common_prefixes(data: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]], most: int) -> np.ndarray:
    """For each place in `order`, how many bytes its suffix shares with the one before, counted to `most`.

    In the order of the text the count falls by one at most from a suffix to the next: that bound is carried
    along, and what is beyond it is found by halving steps, alike where ranks of that depth or bytes agree.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    length = np.zeros(n, np.int64)
    steps = [(h, r) for h, r in reversed(levels) if h <= most] + [(s, None) for s in (4, 2, 1)]
    for step, rank in steps:
        for _ in range(most // step if step >= 8 else 1):
            a, b = here + length, before + length
            open_ = (before >= 0) & (length < most) & (np.maximum(a, b) + step <= n)
            i = np.flatnonzero(open_)
            if rank is not None:
                same = rank[a[i]] == rank[b[i]]
            else:
                same = np.ones(len(i), bool)
                for k in range(step):
                    same &= data[a[i] + k] == data[b[i] + k]
            if not same.any():
                break
            length[i[same]] += step
            length = np.where(before >= 0, np.maximum(length, np.maximum.accumulate(length + here) - here), 0) if step > 8 else length
    return np.minimum(length, most)[order]


class WindowTable:
    """The distinct windows of the texts of one shard, in order, with the least owner of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> None:
        count = np.maximum(0, np.diff(at) - window + 1)
        text = np.repeat(np.arange(len(count)), count)
        self.place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + at[text]
        self.owner = owner[text]
        starts = np.zeros(len(data), bool)
        starts[self.place] = True
        order, _, levels = suffix_array(data, window)
        shared = common_prefixes(data, order, levels, window)
        ours = np.flatnonzero(starts[order])
        # Two windows are alike if every neighbour between them shares a whole window.
        run = np.cumsum(shared < window)[ours]
        new = np.concatenate([[True], run[1:] != run[:-1]]) if len(ours) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        kind = np.zeros(len(data), np.int64)
        kind[order[ours]] = number
        self.kind = kind[self.place]
        self.least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.kind, self.owner)
        first = order[ours][new]
        self.strings = sliding_window_view(data, window)[first].view(f"S{window}").ravel() if len(first) else np.zeros(0, f"S{window}")


def merge(tables: list[WindowTable]) -> None:
    """Make the least owners hold across the tables, by binary search of each one's windows in each other."""
    for i, a in enumerate(tables):
        for b in tables[i + 1 :]:
            if not len(a.strings) or not len(b.strings):
                continue
            at = np.minimum(np.searchsorted(b.strings, a.strings), len(b.strings) - 1)
            same = np.flatnonzero(b.strings[at] == a.strings)
            least = np.minimum(a.least[same], b.least[at[same]])
            a.least[same] = least
            b.least[at[same]] = least
