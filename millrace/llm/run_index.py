"""A run-length index (r-index) of many short texts, and matching statistics against it.

The Burrows-Wheeler transform of the texts is kept as runs; at the first and the last row
of each run the suffix array is sampled. Matching statistics of other texts are streamed
from their right ends, all texts at once: a symbol that the row's run holds is followed by
LF; at any other the row jumps to the nearest run of that symbol above or below, whichever
sample shares more with the place matched so far. That gives the longest match at every
position exactly.

Texts carry a tag, and match only texts of the same tag: a symbol is a byte with its tag.
"""

from __future__ import annotations

import numpy as np

#: Symbols of 9 bits (a byte plus one; 0 ends a text) in the first sort key.
FIRST = 7
#: Codes of a tag: 256 bytes and the end.
CODES = 257


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans (start, size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class RunIndex:
    """An index of the texts ``data[starts:starts+sizes]`` under their tags."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tags: np.ndarray):
        n = int(sizes.sum()) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1  # where each text's end symbol stands
        self.symbol = np.zeros(n, np.int16)
        inner = np.ones(n, bool)
        inner[ends] = False
        self.symbol[inner] = data[flat(starts, sizes)].astype(np.int16) + 1
        self.end = np.repeat(ends, sizes + 1)
        tag = np.repeat(tags.astype(np.int64), sizes + 1)
        order = self._sort(tag, int(sizes.max()) + 1)
        full = tag * CODES + self.symbol
        first = np.zeros(n, bool)
        first[ends - sizes] = True
        before = np.where(first[order], -1, full[order - 1])  # the transform; -1 before a text's first symbol
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        last = np.append(head[1:], n) - 1
        self.head, self.last, self.run = head, last, before[head]
        self.at_head, self.at_last = order[head], order[last]  # the samples
        self.origin = int(order[0])
        # LF of a run's first row: rows whose suffix starts with a smaller symbol, then the same symbol in earlier runs
        by = np.lexsort((head, self.run))
        size = (last - head + 1)[by]
        total = np.cumsum(size) - size
        opens = np.concatenate([[True], self.run[by][1:] != self.run[by][:-1]])
        total -= np.repeat(total[opens], np.diff(np.append(np.flatnonzero(opens), len(by))))
        self.lf = np.empty(len(head), np.int64)
        self.lf[by] = np.searchsorted(full[order], self.run[by]) + total
        by = by[self.run[by] >= 0]
        self.runs = len(head)
        self.key = self.run[by] * self.runs + by

    def _sort(self, tag: np.ndarray, longest: int) -> np.ndarray:
        """The suffix array by prefix doubling; equal suffixes stand in the order of their texts."""
        n = len(tag)
        at = np.arange(n)
        key = np.zeros(n, np.int64)
        for j in range(FIRST):
            there = np.minimum(at + j, n - 1)
            key = key << 9 | np.where(at + j <= self.end, self.symbol[there], 0)
        order = np.lexsort((key, tag))
        opens = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (tag[order][1:] != tag[order][:-1])])
        rank = np.empty(n, np.int64)  # the row where the group of suffixes that are equal so far begins
        rank[order] = np.maximum.accumulate(np.where(opens, at, 0))
        self.ranks: list[tuple[int, np.ndarray]] = [(FIRST, rank.astype(np.int32))]
        length = FIRST
        while length < longest:
            rows = np.flatnonzero(~opens | np.append(~opens[1:], False))  # of groups that are not yet told apart
            if not len(rows):
                break
            tied = order[rows]
            there = tied + length
            key = rank[tied] * (n + 1) + np.where(there <= self.end[tied], rank[np.minimum(there, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            order[rows], key = tied[by], key[by]
            opens[rows] = np.concatenate([[True], key[1:] != key[:-1]])
            rank[order[rows]] = np.maximum.accumulate(np.where(opens[rows], rows, 0))
            length *= 2
            self.ranks.append((length, rank.astype(np.int32)))
        return order

    def shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at p and q share, before either text ends."""
        most = np.minimum(self.end[p] - p, self.end[q] - q)
        out = np.where(p == q, most, 0)
        for length, rank in reversed(self.ranks):
            go = np.flatnonzero(out < most)
            go = go[rank[p[go] + out[go]] == rank[q[go] + out[go]]]
            out[go] += length
        out = np.minimum(out, most)
        for _ in range(FIRST - 1):
            go = np.flatnonzero(out < most)
            x, y = p[go] + out[go], q[go] + out[go]
            go = go[self.symbol[x] == self.symbol[y]]
            out[go] += 1
        return out

    def matching(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The matching statistics of other texts, one after the other: at each place the length
        of the longest prefix of what is left that occurs in a text of the same tag."""
        out = np.zeros(int(sizes.sum()), np.int64)
        by = np.argsort(-sizes, kind="stable")
        begins, size, tag = starts[by], sizes[by], tags[by].astype(np.int64) * CODES + 1
        places = (np.cumsum(sizes) - sizes)[by]
        row, at, length = np.zeros(len(by), np.int64), np.full(len(by), self.origin), np.zeros(len(by), np.int64)
        live = len(by)
        for t in range(1, int(size[0]) + 1 if len(size) else 0):
            while size[live - 1] < t:
                live -= 1
            place = size[:live] - t
            c = tag[:live] + data[begins[:live] + place]
            run = np.searchsorted(self.head, row[:live], "right") - 1
            miss = np.flatnonzero(self.run[run] != c)
            if len(miss):
                want = c[miss] * self.runs
                k = np.searchsorted(self.key, want + run[miss])
                up, down = np.maximum(k - 1, 0), np.minimum(k, len(self.key) - 1)
                has_up, has_down = (k > 0) & (self.key[up] >= want), (k < len(self.key)) & (self.key[down] < want + self.runs) & (self.key[down] >= want)
                up, down = self.key[up] % self.runs, self.key[down] % self.runs
                here, now = at[miss], length[miss]
                by_up = np.where(has_up, np.minimum(now, self._near(here, self.at_last[up], has_up & (now > 0))), -1)
                by_down = np.where(has_down, np.minimum(now, self._near(here, self.at_head[down], has_down & (now > 0))), -1)
                above = by_up >= by_down
                run[miss] = np.where(above, up, down)
                row[miss] = np.where(above, self.last[up], self.head[down])
                at[miss] = np.where(above, self.at_last[up], self.at_head[down])
                length[miss] = np.maximum(by_up, by_down)
            row[:live] = self.lf[run] + row[:live] - self.head[run]
            at[:live] -= 1
            length[:live] += 1
            if len(miss) and len(lost := miss[(by_up < 0) & (by_down < 0)]):  # no text of the tag holds the symbol
                row[lost], at[lost], length[lost] = 0, self.origin, 0
            out[places[:live] + place] = length[:live]
        return out

    def _near(self, p: np.ndarray, q: np.ndarray, where: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        out[where] = self.shared(p[where], q[where])
        return out
