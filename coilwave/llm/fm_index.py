"""A compressed full-text index over integer symbols: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` symbols (equal ones by place), each row's class of equal prefixes, and how many symbols
    each row shares with the one before (`depth` at most; 0 for the first row, and one more entry of 0).

    Classes of length k are doubled until `depth` is reached; the last step overlaps. What two rows share is put together
    from the classes of all lengths, longest first."""
    n = len(text)
    bits = U(max(1, int(n).bit_length()))
    rank = text.astype(np.uint64)
    where = np.arange(n, dtype=np.uint64)
    low = (U(1) << bits) - U(1)
    order = where.astype(np.int64)
    of_length: dict[int, np.ndarray] = {}
    k = 0
    while k < depth:
        step = 0 if not k else min(k, depth - k)
        second = np.zeros(n, np.uint64)
        if step:
            second[: n - step] = rank[step:] + U(1)
        pair = rank * U(n + 1) + second if step else rank
        if int(pair.max(initial=0)).bit_length() + int(bits) <= 64:
            packed = np.sort((pair << bits) | where)
            order, sorted_pair = (packed & low).astype(np.int64), packed >> bits
        else:
            order = np.argsort(pair, kind="stable")
            sorted_pair = pair[order]
        new = np.zeros(n, np.uint64)
        np.cumsum(sorted_pair[1:] != sorted_pair[:-1], out=new[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = new
        k = k + step if k else 1
        of_length[k] = rank.astype(np.int32)
    shared = np.zeros(n + 1, np.int64)
    a, b = order[:-1], order[1:]
    for k in sorted(of_length, reverse=True):
        # beyond the end of the text nothing is shared
        i, j = a + shared[1:n], b + shared[1:n]
        fits = np.maximum(i, j) + k <= n
        same = np.zeros(len(a), bool)
        same[fits] = of_length[k][i[fits]] == of_length[k][j[fits]]
        shared[1:n] += np.where(same & (shared[1:n] + k <= depth), k, 0)
    return order, rank[order].astype(np.int64), shared


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before position i. One packed bit vector a level, a count for each 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.uint32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:], dtype=np.uint32)
            self.bits.append(packed)
            self.counts.append(before)
            self.zeros.append(int(len(bit) - bit.sum()))
            one = bit.astype(bool)
            now = np.concatenate([now[~one], now[one]])
        starts = np.zeros(sigma + 1, np.int64)
        self.first = starts  # of each symbol on the last level
        values, at = np.unique(now, return_index=True)
        starts[values] = at

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = i >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & ((U(1) << (i & 63).astype(np.uint64)) - U(1)))
            i = np.where((c >> level) & 1, self.zeros[k] + ones.astype(np.int64), i - ones)
        return i - self.first[c]


class FMIndex:
    """Backward search over `text` (symbols from 0 on; 0 ends a document), exact for patterns of up to `depth` symbols.

    Suffixes are sorted by their first `depth` symbols, which is as much as such searches look at. An interval [lo, hi) of
    rows stands for all places where a pattern occurs."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        self.depth, self.n, self.sigma = depth, len(text), sigma
        order, of_row, self.shared = suffix_order(text, depth)
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        #: The class of a row: the rows that share its first `depth` symbols; and a class's earliest place in the text.
        self.class_of_row = of_row
        head = np.flatnonzero(np.diff(of_row, prepend=-1))
        self.earliest = np.minimum.reduceat(order, head) if self.n else head
        # for each row the nearest rows above and below that share less with the one before them
        row = np.arange(self.n + 1)
        self.above, self.below = np.zeros(self.n + 1, np.int64), np.full(self.n + 1, self.n)
        for d in range(1, depth + 1):
            own = self.shared == d
            less = self.shared < d
            self.above[own] = np.maximum.accumulate(np.where(less, row, 0))[own]
            self.below[own] = np.minimum.accumulate(np.where(less, row, self.n)[::-1])[::-1][own]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: rows whose suffixes start with c and then what [lo, hi) starts with. Symbols of no row give empty intervals."""
        known = c < self.sigma
        c = np.where(known, c, 0)
        return np.where(known, self.before[c] + self.bwt.rank(c, lo), 0), np.where(known, self.before[c] + self.bwt.rank(c, hi), 0)

    def shrink(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals, and the length of the prefix that all their rows share: what is left when a match loses its end."""
        up, down = self.shared[lo], self.shared[hi]
        left = np.maximum(up, down)
        return np.where(left == 0, 0, np.where(up == left, self.above[lo], lo)), np.where(left == 0, self.n, np.where(down == left, self.below[hi], hi)), left


def matching_statistics(index: FMIndex, text: np.ndarray, end: np.ndarray, length: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Streams documents (text[end - length : end] each, all at once) backwards through an index.

    Returns for each place of `text` the longest match from there on within its document, `depth` symbols at most, that at least
    `least` places of the index have, and the first row of their interval. An interval that a further symbol leaves with
    fewer rows loses symbols at the end of its match until it has enough."""
    match, row = np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
    lane = np.argsort(-length, kind="stable")
    end, length = end[lane], length[lane]
    lo, hi, size = np.zeros(len(end), np.int64), np.full(len(end), index.n), np.zeros(len(end), np.int64)
    for k in range(1, int(length.max(initial=0)) + 1):
        live = int(np.searchsorted(-length, -k, "right"))
        lo, hi, size, at = lo[:live], hi[:live], size[:live], end[:live] - k
        # a match of full length makes room for the symbol in front; other rows may share what is left of it
        full = np.flatnonzero(size == index.depth)
        wide = index.shrink(lo[full], hi[full])
        other = full[wide[2] == index.depth - 1]
        lo[other], hi[other] = wide[0][wide[2] == index.depth - 1], wide[1][wide[2] == index.depth - 1]
        size[full] = index.depth - 1
        todo = np.arange(live)
        while len(todo):
            a, b = index.extend(text[at[todo]], lo[todo], hi[todo])
            ok = b - a >= least
            done = todo[ok]
            lo[done], hi[done] = a[ok], b[ok]
            size[done] += 1
            todo = todo[~ok & (size[todo] > 0)]
            lo[todo], hi[todo], size[todo] = index.shrink(lo[todo], hi[todo])
        match[at], row[at] = size, lo
    return match, row
