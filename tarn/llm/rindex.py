"""A run-length index of many short strings, and matching statistics from its run ends.

The index holds the Burrows-Wheeler transform of the strings (each closed by an end mark of its own), of which only the run ends
are sampled: the length of the match with the row before, at the row to which the step backwards takes a run's first row. Rows
inside a run step backwards side by side and their match grows by one, so the match lengths of all positions follow from the
run ends alone: a position's is that of the next sampled position of its string, and as much more as lies between them.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the strings that lie end to end in ``data`` by their suffixes; of equal suffixes, the earlier string first."""
    n, strings, end = len(data), len(size), np.cumsum(size)
    # as many characters as fit in 63 bits; nothing sorts before every byte
    used = np.flatnonzero(np.bincount(data, minlength=256))
    bits = len(used).bit_length()
    depth = max(1, 63 // max(bits, 1))
    code = np.zeros(256, dtype=np.int64)
    code[used] = np.arange(1, len(used) + 1)
    chars = np.concatenate([code[data], np.zeros(depth, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key = key << bits | chars[k:k + n]
    for k in range(1, depth):  # what lies behind an end
        key[end[size >= k] - k] &= -1 << bits * (depth - k)
    order = np.argsort(key)
    key = key[order]
    # a suffix ranks as the first place of those that are equal so far; only places of several are sorted further
    rank, string = np.empty(n, dtype=np.int64), np.repeat(np.arange(strings), size)
    end, open_ = end[string], np.arange(n)
    while True:
        first = np.ones(len(key) + 1, dtype=bool)
        first[1:-1] = key[1:] != key[:-1]
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(first[:-1], np.arange(len(key)), 0))] if n else open_
        open_ = open_[~(first[:-1] & first[1:])]
        if not open_.size:
            return order
        at = order[open_]
        ahead = at + depth
        # those that end here come first, by string
        rest = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)] + strings, string[at])
        key = rank[at] * (n + strings) + rest
        by = np.argsort(key)
        order[open_], key = at[by], key[by]
        depth *= 2


def common_prefix(data: np.ndarray, room: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, ``most`` at most."""
    out, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for k in range(most):
        x, y = a[live], b[live]
        live = live[(room[x] > k) & (room[y] > k)]
        live = live[data[a[live] + k] == data[b[live] + k]]
        if not live.size:
            break
        out[live] = k + 1
    return out


class RunIndex:
    """Rows of strings (bytes end to end, and their lengths) by suffix, and their matches sampled at the transform's run ends."""

    def __init__(self, data: np.ndarray, size: np.ndarray, depth: int) -> None:
        strings, n = len(size), len(data)
        self.depth, self.rows = depth, strings + n
        end = np.cumsum(size)
        room = np.repeat(end, size) - np.arange(n)
        order = suffix_order(data, size)
        # row r < strings: the end mark of string r; the other rows follow the suffix order
        self.place = np.empty(n, dtype=np.int64)
        self.place[order] = np.arange(strings, strings + n)
        held = size > 0
        before = np.full(n + strings, -1, dtype=np.int16)  # characters before the rows; -1 before a string's first
        before[np.flatnonzero(held)] = data[end[held] - 1]
        begins = np.zeros(n, dtype=bool)
        begins[end[held] - size[held]] = True
        before[strings:] = np.where(begins[order], -1, data[order - 1].astype(np.int16))
        head = np.ones(n + strings, dtype=bool)
        head[1:] = before[1:] != before[:-1]
        self.head = np.flatnonzero(head)
        # where a step backwards from a run's first row leads
        self.sampled = np.concatenate([end - 1, order - 1])[head & (before >= 0)]
        row = self.place[self.sampled] - strings
        self.sample = np.zeros(len(row), dtype=np.int64)
        real = np.flatnonzero(row > 0)
        self.sample[real] = common_prefix(data, room, order[row[real] - 1], order[row[real]], depth)
        self.last = end[held] - 1

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position of the strings, end to end: its row, and how far (up to ``depth``) it matches the row before."""
        n = len(self.place)
        known = np.full(n, -1, dtype=np.int64)
        known[self.last] = 1  # the end marks match nothing
        known[self.sampled] = self.sample
        after = np.minimum.accumulate(np.where(known >= 0, np.arange(n), n)[::-1])[::-1]
        return self.place, np.minimum(known[after] + after - np.arange(n), self.depth)


def first_owners(data: np.ndarray, size: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For every position at which ``depth`` bytes of its string begin, the least owner of a string that has the same
    ``depth`` bytes anywhere; at other positions the largest integer."""
    rows, match = (index := RunIndex(data, size, depth)).statistics()
    room = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    full = np.flatnonzero(room >= depth)
    out = np.full(len(data), np.iinfo(np.int64).max)
    if not full.size:
        return out
    fresh = np.zeros(index.rows, dtype=np.int32)
    fresh[rows[full[match[full] < depth]]] = 1
    # a shorter suffix can't stand between rows that share ``depth`` bytes
    group = np.cumsum(fresh)[rows[full]]
    mine = np.repeat(owner, size)[full]
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, mine)
    out[full] = least[group]
    return out
