"""A run-compressed Burrows-Wheeler index of many short strings, as numpy arrays.

The strings (valid UTF-8 cut anywhere, so no byte is 0xFF) are indexed as one collection, each with
a terminator of its own. Kept are the runs of the transform with a sample at both of their ends.

A run's samples are how many bytes its first suffix shares with the suffix before it, and its last
one with the suffix after it, each one symbol further on. Between run ends both numbers grow by
one with every symbol read, so a string that is read backwards carries along how far it matches
other strings (its matching statistics) and looks a sample up only where it enters a run's end.
"""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, first byte highest; ``text`` has eight to spare."""
    return np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))[at].astype(np.uint64)


_KEEP = np.array([0, *(((1 << 64) - 1) << (64 - 8 * k) & ((1 << 64) - 1) for k in range(1, 9))], np.uint64)


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions by suffix; each suffix ends after left[p] bytes, equal ones go by position."""
    n = len(left)
    key = np.ndarray((n,), ">u8", text, 0, (1,)).astype(np.uint64)
    key &= _KEEP[np.minimum(left, 8)]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0))) + 1
    slots, depth = np.arange(n, dtype=np.int32), 8
    longest = int(left.max(initial=0))
    while True:
        tied = ~new | ~np.r_[new[1:], True]
        slots = slots[tied]
        if not len(slots):
            return order
        at = order[slots]
        done = depth >= longest
        if done:
            second = at
        else:
            second = np.zeros(len(at), np.int32)
            more = left[at] > depth
            second[more] = rank[at[more] + depth]
        key = rank[at].astype(np.uint64) << np.uint64(32)
        key |= second.astype(np.uint64)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        if done:
            return order
        new = np.r_[True, key[1:] != key[:-1]]
        del key, by
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        depth *= 2


def common_bytes(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at each of a and b share; terminators match nothing."""
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int32)
    on = np.flatnonzero(most > 0)
    while len(on):
        x = _words(text, a[on] + out[on]) ^ _words(text, b[on] + out[on])
        same = np.where(x == 0, 8, (64 - _bits(x)) >> 3)
        out[on] = np.minimum(out[on] + same, most[on])
        on = on[(x == 0) & (out[on] < most[on])]
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    """The bit length of each value."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return np.bitwise_count(x).astype(np.int32)


class Marks:
    """Marked rows as bits, and how many are marked up to a row."""

    def __init__(self, marked: np.ndarray):
        words = np.zeros(len(marked) // 64 + 1, np.uint64)
        bits = np.packbits(marked, bitorder="little")
        words.view(np.uint8)[: len(bits)] = bits
        self.words = words
        self.before = (np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)).astype(np.int32)

    def rank(self, rows: np.ndarray) -> np.ndarray:
        """Marked rows up to and with each of ``rows``."""
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        upto = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto)


class RunLengthIndex:
    """``data`` holds the strings one after another, string i from at[i] to at[i+1] and owned by
    owner[i]. Together they have less than 2 GB."""

    def __init__(self, data: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int):
        self.size = size = np.diff(at).astype(np.int32)
        self.window, self.owner, m = window, owner, len(size)
        total = len(data) + m
        text = np.zeros(total + 64, np.uint8)  # a terminator after each string
        of = np.repeat(np.arange(m, dtype=np.int32), size + 1)
        end = at[1:] + np.arange(m)  # of each terminator
        left = (end[of] - np.arange(total)).astype(np.int32)
        text[:total][left > 0] = data + 1
        order = suffix_order(text, left)
        # runs of the transform
        before = text[order - 1]
        before[left[order] == size[of[order]]] = 0
        new = np.empty(total, bool)
        new[:1] = True
        np.not_equal(before[1:], before[:-1], out=new[1:])
        self.run, self.marks = np.flatnonzero(new).astype(np.int32), Marks(new)
        self.last = np.r_[self.run[1:], total].astype(np.int32) - 1
        symbol, length = before[self.run], self.last - self.run + 1
        del before, new
        by = np.argsort(symbol, kind="stable")
        begin = np.cumsum(length[by]) - length[by]
        self.step = np.empty(len(self.run), np.int32)  # LF of a run's first row
        self.step[by] = begin
        # the samples at run ends
        self.upper, self.lower = np.zeros(len(self.run), np.int32), np.zeros(len(self.run), np.int32)
        real = np.flatnonzero(symbol > 0)
        row = self.step[real]
        own = row > 0
        self.upper[real[own]] = common_bytes(text, left, order[row[own]], order[row[own] - 1])
        row = row + length[real] - 1
        own = row + 1 < total
        self.lower[real[own]] = common_bytes(text, left, order[row[own]], order[row[own] + 1])
    def statistics(self):
        """(strings, bytes read, rows, bytes shared with the suffix before, with the one after): all
        strings are read backwards at once, each step following the transform one symbol."""
        rows, alive = np.arange(len(self.size), dtype=np.int32), np.arange(len(self.size), dtype=np.int32)
        upper, lower = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for read in range(1, int(self.size.max(initial=0)) + 1):
            on = self.size[alive] >= read
            if not on.all():
                rows, alive, upper, lower = rows[on], alive[on], upper[on], lower[on]
            run = self.marks.rank(rows) - 1
            first = self.run[run]
            upper = np.where(rows == first, self.upper[run], upper + 1)
            lower = np.where(rows == self.last[run], self.lower[run], lower + 1)
            rows = self.step[run] + (rows - first)
            yield alive, read, rows, upper, lower

    def repeats(self):
        """(string, offset, smallest owner) of each window that occurs more than once. Matches of a
        window or more that follow each other in suffix order are one interval."""
        got = [(np.zeros(0, np.int32),) * 3 + (np.zeros(0, bool),)]
        for alive, read, rows, upper, lower in self.statistics():
            if read >= self.window:
                hit = np.flatnonzero(np.maximum(upper, lower) >= self.window)
                got.append((alive[hit], self.size[alive[hit]] - np.int32(read), rows[hit], upper[hit] >= self.window))
        string, offset, rows, joined = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(rows):
            return string, offset, self.owner[:0]
        by = np.argsort(rows)
        string, offset = string[by], offset[by]
        first = np.flatnonzero(~joined[by])
        least = np.minimum.reduceat(self.owner[string], first)
        return string, offset, np.repeat(least, np.diff(np.r_[first, len(by)]))
