"""An FM-index over a wavelet matrix, searched for many patterns at once.

Everything is a NumPy array: the bit vectors are packed into 64-bit words with a running count
per word, and a backward-search step is taken for all patterns together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (symbols 0..sigma-1) in order of their first ``depth`` symbols."""
    n, bits = len(t), max(1, int(sigma).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] |= t[j:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    # only what still ties is sorted again, within its places
    tied = np.flatnonzero(~first | ~np.append(first[1:], True))
    while k < depth and len(tied):
        at = order[tied]
        after = np.zeros(len(at), np.int64)
        inside = at + k < n
        after[inside] = rank[at[inside] + k] + 1
        key = rank[at] * np.int64(n + 2) + after
        o = np.argsort(key, kind="stable")
        at, s = at[o], key[o]
        order[tied] = at
        first = np.concatenate([[True], s[1:] != s[:-1]])
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~first | ~np.append(first[1:], True)]
        k *= 2
    return order


MASKS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    def __init__(self, t: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        cur = t.astype(np.int64)
        for level in reversed(range(self.bits)):
            b = (cur >> level) & 1
            packed = np.packbits(b.astype(np.uint8), bitorder="little")
            words = np.zeros(len(cur) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.levels.append((level, words, ones, int(len(cur) - b.sum())))
            cur = np.concatenate([cur[b == 0], cur[b == 1]])
        self.symbol_bits = [((np.arange(sigma) >> level) & 1).astype(bool) for level in range(self.bits)]
        self.base = self.position(np.arange(sigma), np.zeros(sigma, np.int64))

    def position(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, words, ones, zeros in self.levels:
            w = i >> 6
            r = ones[w] + np.bitwise_count(words[w] & MASKS[i & 63])
            i = np.where(self.symbol_bits[level][c], zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before ``i``."""
        return self.position(c, i) - self.base[c]


class FMIndex:
    """Texts of labelled owners; label -1 is a text of several owners.

    A pattern counts as found for an owner where it occurs in a text of another owner; what a text of several owners
    holds is found for it wherever it occurs, itself included.
    """

    def __init__(self, texts: list[np.ndarray], labels: list[int]):
        size = np.array([len(x) for x in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        self.end = self.start + size
        flat = np.zeros(int((size + 1).sum()), np.int64)
        for s, x in zip(self.start, texts):
            flat[s : s + len(x)] = x.astype(np.int64) + 1
        symbols, self.t = np.unique(flat, return_inverse=True)
        sa = suffix_array(self.t, len(symbols), int(size.max()) + 1)
        self.wavelet = WaveletMatrix(self.t[sa - 1], len(symbols))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.t, minlength=len(symbols)))])
        self.labels = np.array(labels, np.int64)
        self.owner = np.repeat(self.labels, size + 1)[sa]
        n = len(sa)
        change = np.append(np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1, n)
        self.next_other = change[np.searchsorted(change, np.arange(n), "right")]

    def extend(self, text: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each text and end, the leftmost start, not before ``limit``, from which [start, end) is found elsewhere."""
        i = end.copy()
        live = np.flatnonzero(i > limit)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.t), np.int64)
        while len(live):
            c = self.t[i[live] - 1]
            both = self.before[np.concatenate([c, c])] + self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = both[: len(live)], both[len(live) :]
            at = np.minimum(lo, len(self.owner) - 1)
            mine = self.labels[text[live]]
            ok = (lo < hi) & ((self.owner[at] != mine) | (mine < 0) | (self.next_other[at] < hi))
            live, lo, hi = live[ok], lo[ok], hi[ok]
            i[live] -= 1
            more = i[live] > limit[live]
            live, lo, hi = live[more], lo[more], hi[more]
        return i

    def longest(self, text: np.ndarray, start: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The greatest end in [least, most] for which [start, end) is found elsewhere; least - 1 where none is.

        A slice of a found slice is found, so the end is found by bisection, all texts at once. Both bounds
        are tried first: most texts end at one of them.
        """
        lo, hi = least - 1, most.copy()
        for bound in (least, most):
            k = np.flatnonzero(lo < hi)
            ok = self.extend(text[k], bound[k], start[k]) == start[k]
            if bound is least:
                lo[k[ok]] = bound[k[ok]]
                hi[k[~ok]] = bound[k[~ok]] - 1
            else:
                lo[k[ok]] = hi[k[ok]]
                hi[k[~ok]] -= 1
        while len(k := np.flatnonzero(lo < hi)):
            mid = (lo[k] + hi[k] + 1) // 2
            ok = self.extend(text[k], mid, start[k]) == start[k]
            lo[k[ok]] = mid[ok]
            hi[k[~ok]] = mid[~ok] - 1
        return lo

    def shared(self, length: int, at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(text, start, end) that together cover the runs of ``length`` found elsewhere that hold the text's anchor.

        The anchor of a text is its slice [at, at + k). From the farthest end that the anchor reaches, the
        match is extended to the left; where it stops, at j, the farthest end for a start at j comes next.
        """
        out = []
        text = np.flatnonzero(self.end - self.start >= length)
        anchor = self.start[text] + np.asarray(at, np.int64)[text]
        end = self.longest(text, anchor, anchor + k, self.end[text])
        while True:
            keep = (end >= anchor + k) & (end - self.start[text] >= length)
            text, anchor, end = text[keep], anchor[keep], end[keep]
            if not len(text):
                return out
            a = self.start[text]
            i = self.extend(text, end, a)
            hit = end - i >= length
            out += zip(text[hit].tolist(), (i - a)[hit].tolist(), (end - a)[hit].tolist())
            rest = i > a
            text, anchor, end, j = text[rest], anchor[rest], end[rest], i[rest] - 1
            end = self.longest(text, j, anchor + k, end - 1)
