"""An FM-index over integer symbols: wavelet-tree ranks, backward search and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8  # every eighth position is kept
_ONE = np.uint64(1)


class Bits:
    """A bit string with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _ONE == _ONE

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = self.words[word] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE)
        return self.before[word] + np.bitwise_count(below)


class Wavelet:
    """Ranks of symbols, one bit string per bit of a symbol, from the highest."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(ones) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, zeros, bit in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            ones = level.rank(i)
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._walk(symbol, i) - self.first[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.get(i), level.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.first[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by doubling the number of symbols compared. The last symbol must be unique."""
    n = len(symbols)
    high = int(symbols.max()) + 2
    near = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(2, np.int64)])
    width = 3 if high**3 < 1 << 62 else 1
    key = (near[:n] * high + near[1 : n + 1]) * high + near[2 : n + 2] if width == 3 else near[:n]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + later
        width *= 2


class FmIndex:
    """Segments of symbols (2 and above), searched together; symbols of different segments never match as one."""

    def __init__(self, segments: list[np.ndarray], sigma: int):
        lengths = np.array([len(s) for s in segments], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        n = int((lengths + 1).sum())
        text = np.ones(n, np.int64)  # 1 ends a segment
        inside = np.ones(n, bool)
        inside[self.starts + lengths] = False
        text[inside] = np.concatenate(segments)
        # Ends of segments differ from each other, so that equal segments are told apart at their end.
        apart = text + len(segments)
        apart[~inside] = np.arange(len(segments))
        order = suffix_order(apart)
        self.wavelet = Wavelet(text[order - 1], sigma)
        counts = np.bincount(text, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        kept = np.zeros(n, bool)
        kept[::SAMPLE] = True
        kept[self.starts] = True
        marked = kept[order]
        self.marked = Bits(marked)
        self.positions = order[marked]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each phrase (rows of equal length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment and offset of each suffix: back symbol by symbol to a kept position."""
        position, steps, at, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(at):
            here = self.marked.get(row)
            position[at[here]] = self.positions[self.marked.rank(row[here])] + steps
            at, row = at[~here], row[~here]
            symbol, rank = self.wavelet.symbol_and_rank(row)
            row = self.before[symbol] + rank
            steps += 1
        segment = np.searchsorted(self.starts, position, "right") - 1
        return segment, position - self.starts[segment]
