"""A compressed FM-index over sequences of numbers, and matching statistics by backward search.

The last column of the sorted suffixes is kept as a wavelet matrix: one packed
bit vector per bit of a symbol, with a count for each word of 64 bits. All
searches advance together, one symbol per step.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bits.dtype)), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = self.words[word] & ((ONE << (at & 63).astype(np.uint64)) - ONE)
        return self.before[word] + np.bitwise_count(below)


class FMIndex:
    """Index of texts laid end to end; a search never crosses from one text to the next.

    ``depth`` bounds the length of a search: suffixes are sorted no further.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, depth: int):
        self.alphabet, codes = np.unique(symbols, return_inverse=True)
        text = np.zeros(len(symbols) + len(ends), np.int64)  # 0 stands after each text
        starts = np.concatenate([[0], ends[:-1]])
        self.places = np.arange(len(symbols)) + np.repeat(np.arange(len(ends)), ends - starts)
        text[self.places] = codes + 1
        order = self._sorted(text, depth)
        last = text[order - 1]
        self.codes = text
        self.n_before = np.searchsorted(np.sort(text), np.arange(len(self.alphabet) + 2))
        self.levels, self.zeros = [], []
        for bit in reversed(range(int(len(self.alphabet)).bit_length())):
            ones = (last >> bit) & 1
            self.levels.append((bit, Bits(ones.astype(np.uint8))))
            self.zeros.append(int(len(last) - ones.sum()))
            last = last[np.argsort(ones, kind="stable")]

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> np.ndarray:
        """Places in the order of their first ``depth`` symbols, by doubling."""
        rank, length = text.copy(), 1
        while True:
            order = np.argsort(rank, kind="stable")
            if length >= depth:
                return order
            new = np.empty(len(rank), bool)
            following = np.zeros(len(rank), np.int64)
            following[: max(0, len(rank) - length)] = rank[length:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + following
            order = np.argsort(key, kind="stable")
            new[:1] = False
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(new)
            length *= 2
            if new.sum() == len(key) - 1:
                return order

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code stands before each place of the last column."""
        low = np.zeros(len(at), np.int64)
        high = at.astype(np.int64)
        for (bit, bits), zeros in zip(self.levels, self.zeros):
            one = ((code >> bit) & 1).astype(bool)
            ranks = bits.rank(np.concatenate([low, high]))
            low_ones, high_ones = ranks[: len(low)], ranks[len(low) :]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the searched strings with one more symbol in front."""
        ranks = self.rank(np.concatenate([code, code]), np.concatenate([low, high]))
        base = self.n_before[code]
        return base + ranks[: len(low)], base + ranks[len(low) :]

    def reach(self, ends: np.ndarray, lows: np.ndarray) -> np.ndarray:
        """How far left of each end (a place of the text) the string up to it still occurs twice, down to ``lows``.

        The string from the returned place to the end occurs at least twice, and
        the one that starts a symbol earlier does not (or starts before ``lows``).
        """
        at = ends.copy()
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.codes), np.int64)
        active = np.flatnonzero(at > lows)
        while len(active):
            new_low, new_high = self.extend(self.codes[at[active] - 1], low[active], high[active])
            go = new_high - new_low >= 2
            active = active[go]
            low[active], high[active] = new_low[go], new_high[go]
            at[active] -= 1
            active = active[at[active] > lows[active]]
        return at


def repeated_windows(index: FMIndex, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For texts of the index, as a bit mask, which windows of ``width`` symbols occur twice in it.

    A search from the end of a stretch gives its matching statistic: the windows
    inside the match are repeated, and those that hold the match and the symbol
    before it are not. Only what is left between is searched again.
    """
    mask = np.zeros(len(starts), np.uint64)

    def mark(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Windows that start from first to last, as places of the text."""
        use = last >= first
        owner, first, n = owner[use], first[use], (last - first + 1)[use]
        first = first - starts[owner]
        bits = np.where(n >= 64, ~np.uint64(0), (ONE << np.minimum(n, 63).astype(np.uint64)) - ONE)
        np.bitwise_or.at(mask, owner, bits << first.astype(np.uint64))

    # From the end: the match of the whole text.
    owner = np.arange(len(starts))
    end = ends.copy()
    match = index.reach(end, starts[owner])
    mark(owner, match, end - width)
    fail = match - 1  # windows that start at or before it and end before ``end`` are open
    gaps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        open_ = (fail >= starts[owner]) & (end - 1 - width >= starts[owner])
        owner, fail, end = owner[open_], fail[open_], end[open_]
        if not len(owner):
            break
        stop = np.minimum(fail + 1, end - 1)
        match = index.reach(stop, starts[owner])
        mark(owner, match, stop - width)
        # Windows that end after the stop and start after the new failure.
        gaps.append((owner, np.maximum(match, stop - width + 1), np.minimum(fail, end - 1 - width)))
        end, fail = stop, match - 1
    if gaps:
        owner, at, last = (np.concatenate(parts) for parts in zip(*gaps))
        while True:
            use = at <= last
            owner, at, last = owner[use], at[use], last[use]
            if not len(owner):
                break
            match = index.reach(at + width, at)
            found = match <= at
            mark(owner[found], at[found], at[found])
            at = np.where(found, at + 1, match)
    return mask
