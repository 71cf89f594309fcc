"""A compressed full-text index over integer symbols: truncated suffix order, BWT in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

LIMIT = 1 << 21  # symbols of an index: two ranks and a position then fit in one 63-bit sort key


class Bits:
    """A bit vector with counts every 64 bits: rank in constant time, 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class WaveletMatrix:
    """One bit vector per bit of the symbols, each level sorted by the bits above."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        s = symbols
        for b in range(self.bits - 1, -1, -1):
            one = (s >> b & 1).astype(bool)
            self.levels.append(Bits(one))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate([s[~one], s[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Symbols ``c`` before position ``i``, for many at once."""
        first, at = np.zeros_like(i), i.copy()
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (c >> (self.bits - 1 - level) & 1).astype(bool)
            f1, a1 = bits.rank1(first), bits.rank1(at)
            first = np.where(one, zeros + f1, first - f1)
            at = np.where(one, zeros + a1, at - a1)
        return at - first


class FMIndex:
    """Index of a symbol array (0 separates texts and is never searched) for patterns of at most ``depth`` symbols.

    Suffixes are sorted by their first ``depth`` symbols only; that is enough for the intervals of such patterns.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        if n > LIMIT:
            raise ValueError(f"{n} symbols; split the shard at {LIMIT}")
        self.depth, self.n = depth, n
        self.sigma = int(symbols.max(initial=0)) + 1
        rank = {1: symbols.astype(np.int64)}
        k = 1
        while 2 * k <= depth:
            rank[2 * k] = self._doubled(rank[k], rank[k], k)
            k *= 2
        self.ranks = np.array(list(rank.values()))

        def of(m: int) -> np.ndarray:
            """Ranks by the first ``m`` symbols."""
            p = 1 << (m.bit_length() - 1)
            return rank[p] if p == m else self._doubled(rank[p], rank[p], m - p)

        full = of(depth)
        order = np.argsort(full, kind="stable")
        self.suffixes = order.astype(np.int32)
        self.groups = full[order]
        if depth > 1:
            shorter = of(depth - 1)[order]
            new = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
            which = np.cumsum(np.concatenate([[True], shorter[1:] != shorter[:-1]])) - 1
            self.low, self.high = new[which], np.append(new[1:], n)[which]
        self.bwt = WaveletMatrix(symbols[order - 1], self.sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))])

    def _doubled(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Ranks by the first symbols behind ``a``, then by those behind ``b`` ``k`` places on; the end counts as 0."""
        n = len(a)
        key = a << 21
        key[: n - k] |= b[k:] if n > k else 0
        packed = np.sort(key << 21 | np.arange(n)) if n else key
        at, val = packed & (LIMIT - 1), packed >> 21
        out = np.empty(n, np.int64)
        out[at] = np.cumsum(np.concatenate([[False], val[1:] != val[:-1]])) if n else 0
        return out

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``c`` put before the patterns of the intervals ``low..high``."""
        both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([low, high]))
        return self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]

    def matching(self, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Matching statistics of many texts at once, right to left: yields ``lanes, positions, lengths, rows``.

        ``length`` is that of the longest prefix (of at most ``depth`` symbols) of the text from ``position`` on that occurs in the
        index, ``row`` the first of its interval.  When a symbol cannot be put before a match, the match loses symbols at its right end
        until it can: a shorter prefix is a wider interval of the sorted suffixes.
        """
        lanes = np.arange(len(starts))
        low, high, size = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64), np.zeros(len(starts), np.int64)
        pos = ends.astype(np.int64).copy()
        while True:
            live = pos[lanes] > starts[lanes]
            lanes = lanes[live]
            if not len(lanes):
                return
            pos[lanes] -= 1
            c = texts[pos[lanes]]
            full = size[lanes] == self.depth
            if full.any():
                cut = lanes[full]
                low[cut], high[cut], size[cut] = self.low[low[cut]], self.high[low[cut]], self.depth - 1
            known = (c >= 0) & (c < self.sigma)
            l, h = self.extend(np.where(known, c, 0), low[lanes], high[lanes])
            good = known & (l < h)
            lost = np.flatnonzero(~good & known & (size[lanes] > 0))
            if len(lost):
                # the longest shorter match that takes the symbol, by bisection over its length; the symbol alone always goes
                sym, row = c[lost], low[lanes[lost]]
                least, most = np.zeros(len(lost), np.int64), size[lanes[lost]] - 1
                a, b = self.extend(sym, np.zeros(len(lost), np.int64), np.full(len(lost), self.n, np.int64))
                while (todo := np.flatnonzero(least < most)).size:
                    mid = (least[todo] + most[todo] + 1) // 2
                    x, y = self.extend(sym[todo], *self._shorter(row[todo], mid))
                    fits = x < y
                    least[todo[fits]] = mid[fits]
                    a[todo[fits]], b[todo[fits]] = x[fits], y[fits]
                    most[todo[~fits]] = mid[~fits] - 1
                some = a < b
                at = lost[some]
                l[at], h[at], good[at] = a[some], b[some], True
                size[lanes[at]] = least[some]
            ok = lanes[good]
            low[ok], high[ok] = l[good], h[good]
            size[ok] += 1
            bad = lanes[~good]
            low[bad], high[bad], size[bad] = 0, self.n, 0
            yield lanes, pos[lanes], size[lanes], low[lanes]

    def _shorter(self, rows: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that share their first ``m`` symbols with ``rows``, by bisection of the sorted suffixes on both sides.

        Whether a suffix shares them is told by the ranks of two overlapping power-of-two prefixes, so a step costs the same at any size.
        """
        level = np.frexp(m.astype(float))[1] - 1
        reach = m - (1 << level)
        at = self.suffixes[rows].astype(np.int64)
        one, two = self.ranks[level, at], self.ranks[level, np.minimum(at + reach, self.n - 1)]

        def edge(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
            """The last place from ``inner`` towards ``outer`` that shares them; ``outer`` itself does not."""
            while (todo := np.flatnonzero(np.abs(outer - inner) > 1)).size:
                mid = (inner[todo] + outer[todo]) // 2
                at = self.suffixes[mid].astype(np.int64)
                same = (self.ranks[level[todo], at] == one[todo]) & (self.ranks[level[todo], np.minimum(at + reach[todo], self.n - 1)] == two[todo])
                inner[todo[same]], outer[todo[~same]] = mid[same], mid[~same]
            return inner

        return edge(rows.copy(), np.full(len(rows), -1, np.int64)), edge(rows.copy(), np.full(len(rows), self.n, np.int64)) + 1
