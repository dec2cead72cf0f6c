"""A run-compressed Burrows-Wheeler index of a bounded block of byte strings, and matching statistics streamed over it.

The index keeps the transform as runs, and suffix positions at the two ends of every run only.  Streams are read from their
ends backwards, all in step: while the transform at a stream's row has the wanted symbol the match grows; otherwise the row
moves to the nearest run of that symbol above or below, whichever agrees with the match further, and the match shrinks to
that.  Lengths are counted up to a cap, beyond which nobody asks.  Matches are compared symbol by symbol, never by hashes.
"""

from __future__ import annotations

import numpy as np

PACKED = 7  # symbols in one comparison; a symbol is a byte plus 1 (0 ends a string), so 9 bits wide


def joined(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the strings ``data[start : start + length]``, each closed by a 0, and where each begins."""
    at = np.r_[0, np.cumsum(length + 1)]
    out = np.zeros(at[-1], np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    out[inner] = data[np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())].astype(np.int64) + 1
    return out, at[:-1]


def _packed(text: np.ndarray) -> np.ndarray:
    """From every position the next ``PACKED`` symbols as one number."""
    padded, key = np.r_[text, np.zeros(PACKED, np.int64)], np.zeros(len(text), np.int64)
    for i in range(PACKED):
        key = key << 9 | padded[i : i + len(text)]
    return key


def _suffix_order(key: np.ndarray) -> np.ndarray:
    """All suffixes in order, from their first symbols, by doubling the compared length where some are still equal."""
    n, known = len(key), PACKED
    order = np.argsort(key)
    rank = np.empty(n, np.int64)  # where a suffix's group of equals begins
    slots, key = np.arange(n), key[order]
    while True:
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(new[:-1], slots, 0))
        slots = slots[~(new[:-1] & new[1:])]
        if not len(slots):
            return order
        mine = order[slots]
        after = np.where(mine + known < n, rank[np.minimum(mine + known, n - 1)] + 1, 0)  # the empty suffix comes first
        key = rank[mine] * (n + 1) + after
        by = np.argsort(key)
        order[slots], key, known = mine[by], key[by], 2 * known


class RunIndex:
    """Index of ``text``, symbols of strings as ``joined`` gives them."""

    def __init__(self, text: np.ndarray):
        self.key = _packed(text)
        order = _suffix_order(self.key)
        last = np.where(order > 0, text[order - 1], 0)
        self.start = np.r_[0, np.flatnonzero(np.diff(last)) + 1]
        self.end = np.r_[self.start[1:], len(last)] - 1
        self.head = last[self.start]
        self.first_suffix, self.last_suffix = order[self.start], order[self.end]
        self.runs = len(self.start)
        self.names = np.sort(self.head * self.runs + np.arange(self.runs))
        self.by_head = self.names % self.runs
        size = (self.end - self.start + 1)[self.by_head]
        self.into = np.empty(self.runs, np.int64)  # row that the first row of a run is preceded by
        self.into[self.by_head] = np.cumsum(size) - size

    def _agreement(self, key: np.ndarray, mine: np.ndarray, suffix: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Symbols that the stream from ``mine`` and the text from ``suffix`` have in common, up to ``limit``."""
        out = np.zeros(len(mine), np.int64)
        open_ = np.flatnonzero(limit > 0)
        while len(open_):
            a, b = mine[open_] + out[open_], suffix[open_] + out[open_]
            other = np.where(b < len(self.key), self.key[np.minimum(b, len(self.key) - 1)], 0)
            differ = key[np.minimum(a, len(key) - 1)] ^ other
            same = np.zeros(len(open_), np.int64)
            for i in range(1, PACKED + 1):
                same += differ >> (9 * (PACKED - i)) == 0
            out[open_] += same
            open_ = open_[(same == PACKED) & (out[open_] < limit[open_])]
        return np.minimum(out, limit)

    def long_matches(self, text: np.ndarray, at: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Streams and places in them where ``window`` symbols begin that the index has, ordered by stream and place."""
        key = _packed(text)
        row, match = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(int(length.max(initial=0))):
            live = np.flatnonzero(length > step)
            place = length[live] - 1 - step
            here = at[live] + place
            symbol, q, m = text[here], row[live], match[live]
            run = np.searchsorted(self.start, q, side="right") - 1
            moved = np.ones(len(live), bool)
            off = np.flatnonzero(self.head[run] != symbol)
            if len(off):
                want = symbol[off]
                below = np.searchsorted(self.names, want * self.runs + run[off])
                best, to_row, to_run = np.full(len(off), -1), np.zeros(len(off), np.int64), np.zeros(len(off), np.int64)
                for slot, rows, suffixes in ((below - 1, self.end, self.last_suffix), (below, self.start, self.first_suffix)):
                    fits = (slot >= 0) & (slot < self.runs)
                    there = self.by_head[np.clip(slot, 0, self.runs - 1)]
                    fits = np.flatnonzero(fits & (self.head[there] == want))
                    there = there[fits]
                    common = self._agreement(key, here[off[fits]] + 1, suffixes[there], m[off[fits]])
                    better = common > best[fits]
                    fits, there, common = fits[better], there[better], common[better]
                    best[fits], to_row[fits], to_run[fits] = common, rows[there], there
                moved[off] = best >= 0
                q[off], run[off], m[off] = to_row, to_run, np.maximum(best, 0)
            q = np.where(moved, self.into[run] + q - self.start[run], 0)
            m = np.where(moved, np.minimum(m + 1, window), 0)
            row[live], match[live] = q, m
            hit = m >= window
            found.append((live[hit], place[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stream, place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, stream))
        return stream[order], place[order]


def earlier_matches(
    group: np.ndarray, rank: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Strings and places in them where ``window`` bytes begin that a string of the same group and a smaller rank has too.

    Strings of different groups share no such bytes.  Ranks are dense from 0 in every group.  They are settled by halves:
    the lower half of every stretch of ranks is indexed, the upper half streamed over it.
    """
    strings, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    level = 0
    while int(rank.max(initial=0)) >> level:
        node, upper = rank >> (level + 1), rank >> level & 1 == 1
        for j in range(int(node.max()) + 1):
            mine = np.flatnonzero(node == j)
            streams = mine[upper[mine]]
            base = mine[~upper[mine]]
            base = base[np.isin(group[base], group[streams])]
            if not len(streams):
                continue
            index = RunIndex(joined(data, start[base], length[base])[0])
            text, at = joined(data, start[streams], length[streams])
            s, p = index.long_matches(text, at, length[streams], window)
            strings.append(streams[s])
            places.append(p)
        level += 1
    s, p = np.concatenate(strings), np.concatenate(places)
    return s, p
