"""A run-compressed Burrows-Wheeler index of a set of short texts, and matching statistics streamed over it.

Only runs are kept: the symbol that each run of the transform holds, where it starts, where the last-to-first mapping of its
first row leads, and the text positions sampled at both of its ends. Many patterns are streamed at once, from
their ends, a symbol a step: while the row's run holds the symbol, the mapping follows it; otherwise the row moves to the
nearer end, by text comparison from the sampled positions, of the neighbouring runs that hold it.
"""

from __future__ import annotations

import numpy as np

END = 256  # after each text; smaller than nothing, equal to itself in sorting only


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes in order; for each position a number that is the same where `depth` symbols are; such numbers for shorter widths."""
    n = len(codes)
    # Seven symbols of nine bits to begin with; 0 past the end.
    width, same, by_width = min(7, depth), None, []
    rank = np.zeros(n, np.int64)
    for i in range(width):
        rank <<= 9
        rank[: n - i] += codes[i:].astype(np.int64) + 1
    while True:
        order = np.argsort(rank)
        seen = rank[order]
        new = np.ones(n, bool)
        new[1:] = seen[1:] != seen[:-1]
        dense = np.cumsum(new)
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if same is None and (width * 2 > depth or dense[-1] == n):
            # Two overlapping windows of the width make one of the depth.
            more = np.zeros(n, np.int64)
            more[: n - (depth - width)] = rank[depth - width :] if width < depth else 0
            same = rank * (n + 1) + more
        if width <= depth:
            by_width.append((width, rank.astype(np.int32)))
        if dense[-1] == n:
            return order, same, by_width[::-1]
        ahead = np.zeros(n, np.int64)
        ahead[:-width] = rank[width:]
        rank = rank * (n + 1) + ahead
        width *= 2


class RunIndex:
    """Index of texts given as one array of symbols in which each text ends with END."""

    def __init__(self, codes: np.ndarray, depth: int):
        """Matching statistics are exact up to `depth` symbols."""
        self.codes, self.depth, n = codes, depth, len(codes)
        order, self.same, self.by_width = suffix_order(codes, depth)
        ends = np.flatnonzero(codes == END)
        self.left = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)).astype(np.int32)  # symbols up to the text's END
        before = codes[order - 1]  # position 0 follows the last END
        new = np.ones(n, bool)
        new[1:] = before[1:] != before[:-1]
        self.run = np.flatnonzero(new)
        self.symbol = before[self.run].astype(np.int64)
        stops = np.append(self.run[1:], n) - 1
        self.head, self.tail = order[self.run], order[stops]  # sampled run ends
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.to = row[(self.head - 1) % n]
        self.back = row[(self.tail - 1) % n]
        # Where runs start, as bits with counts per word: a row's run is a rank.
        self.bits = np.packbits(np.append(new, np.zeros(-n % 64, bool)), bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.bits).astype(np.int64)))
        # Runs by symbol, to find the neighbours that hold it.
        self.by_symbol = np.sort(self.symbol * len(self.run) + np.arange(len(self.run)))

    def run_of(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        upto = self.bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (row & 63).astype(np.uint64)))
        return self.before[word] + np.bitwise_count(upto) - 1

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols, at most depth, in which the texts from a and from b agree."""
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.depth).astype(np.int64)
        out, n = np.zeros(len(a), np.int64), len(self.codes)
        for width, rank in self.by_width:
            while len(on := np.flatnonzero(out + width <= most)):
                x, y = a[on] + out[on], b[on] + out[on]
                same = on[rank[x] == rank[y]]
                out[same] += width
                if width * 2 <= self.depth or not len(same):
                    break
        on = np.arange(len(a))
        for _ in range(self.by_width[-1][0]):
            on = on[out[on] < most[on]]
            on = on[self.codes[np.minimum(a[on] + out[on], n - 1)] == self.codes[np.minimum(b[on] + out[on], n - 1)]]
            out[on] += 1
        return out

    def stream(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the patterns codes[start:stop]: the longest match with any text (at most depth), and where.

        Patterns are pieces of the array itself, so that comparisons run on it; a pattern's own place is as good a match
        as any other of the same length.
        """
        n, runs = len(self.codes), len(self.run)
        length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        row = np.zeros(len(starts), np.int64)
        pos = np.full(len(starts), -1)
        size = np.zeros(len(starts), np.int64)
        at = stops - 1
        alive = np.flatnonzero(at >= starts)
        while len(alive):
            i, r = at[alive], row[alive]
            c = self.codes[i].astype(np.int64)
            run = self.run_of(r)
            same = (self.symbol[run] == c) & (pos[alive] >= 0)
            new_row, new_pos, new_size = np.empty_like(r), np.empty_like(r), np.empty_like(r)
            # Inside a run of the symbol, the mapping keeps the distance from the run's first row.
            new_row[same] = self.to[run[same]] + r[same] - self.run[run[same]]
            new_pos[same] = pos[alive][same] - 1
            new_size[same] = np.minimum(size[alive][same] + 1, self.depth)
            jump = np.flatnonzero(~same)
            if len(jump):
                key = np.searchsorted(self.by_symbol, c[jump] * runs + run[jump])
                low = self.by_symbol[np.maximum(key - 1, 0)]
                high = self.by_symbol[np.minimum(key, runs - 1)]
                has_low = (key > 0) & (low // runs == c[jump])
                has_high = (key < runs) & (high // runs == c[jump])
                low, high = low % runs, high % runs
                after = i[jump] + 1
                fit_low = np.where(has_low, self.agree(self.tail[low], after), -1)
                fit_high = np.where(has_high, self.agree(self.head[high], after), -1)
                up = fit_high > fit_low
                fit = np.minimum(np.where(up, fit_high, fit_low), stops[alive[jump]] - after)
                new_row[jump] = np.where(up, self.to[high], self.back[low])
                new_pos[jump] = np.where(up, self.head[high], self.tail[low]) - 1
                new_size[jump] = np.minimum(fit + 1, self.depth)
            row[alive], pos[alive], size[alive] = new_row, new_pos % n, new_size
            length[i], place[i] = new_size, new_pos % n
            at[alive] -= 1
            alive = alive[at[alive] >= starts[alive]]
        return length, place
