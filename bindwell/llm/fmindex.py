"""A compressed full-text index over words: BWT in a wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

_WORD = 64


class Bits:
    """A packed bit vector with a rank directory."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // _WORD) * _WORD, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)))[:-1].astype(np.int32)
        self.ones = int(bits.sum())
        self.zeros = len(bits) - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank queries over a sequence of codes below ``2 ** levels``."""

    def __init__(self, codes: np.ndarray, levels: int):
        self.levels: list[Bits] = []
        for level in range(levels - 1, -1, -1):
            bit = (codes >> level) & 1
            self.levels.append(Bits(bit))
            codes = np.concatenate((codes[bit == 0], codes[bit == 1]))

    def rank(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the codes' run begins, and how many of each are before ``low`` and before ``high``."""
        begin = np.zeros(len(code), np.int64)
        low, high = low.astype(np.int64), high.astype(np.int64)
        for k, bits in enumerate(self.levels):
            one = ((code >> (len(self.levels) - 1 - k)) & 1).astype(bool)
            b, lo, hi = bits.rank(begin), bits.rank(low), bits.rank(high)
            begin = np.where(one, bits.zeros + b, begin - b)
            low = np.where(one, bits.zeros + lo, low - lo)
            high = np.where(one, bits.zeros + hi, high - hi)
        return begin, low - begin, high - begin


class FMIndex:
    """Index of a text of word codes (0 separates its parts), exact for matches of up to ``depth`` words.

    The text itself and its suffix array are not kept: the BWT stands in a wavelet matrix, and of each
    suffix only the owner of its place (a small number a part) in 32 bits.
    """

    def __init__(self, codes: np.ndarray, depth: int, owners: np.ndarray):
        rank, step = codes.astype(np.int64), 1
        while step < depth:  # prefix doubling: suffixes in order of their first ``depth`` words
            ahead = np.zeros(len(rank), np.int64)
            ahead[:-step] = rank[step:] + 1
            rank = np.unique(rank * (int(rank.max(initial=0)) + 3) + ahead, return_inverse=True)[1]
            step *= 2
        suffixes = np.argsort(rank, kind="stable")
        most = int(codes.max(initial=0))
        self.size = len(codes)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=most + 1))))
        self.matrix = WaveletMatrix(codes[suffixes - 1], max(1, most.bit_length()))
        self.owners = owners[suffixes].astype(np.int32)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of ``code`` followed by what the given ranges stand for."""
        _, before_low, before_high = self.matrix.rank(code, low, high)
        return self.first[code] + before_low, self.first[code] + before_high

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many words of ``stream`` up to each of ``ends`` stand at two or more places of the text, up to ``most``, and their suffix ranges.

        Backward search goes on word by word and all places at once; a place whose match stands only once has its statistic.
        """
        reach = np.zeros(len(ends), np.int64)
        first, last = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        alive, low, high = np.arange(len(ends)), first, last
        for k in range(most):
            low, high = self.extend(stream[ends[alive] - k], low, high)
            more = np.flatnonzero(high - low > 1)
            alive, low, high = alive[more], low[more], high[more]
            if not len(alive):
                break
            reach[alive], first[alive], last[alive] = k + 1, low, high
        return reach, first, last

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in each of the suffix ranges, which are equal or apart."""
        begins, back, number = np.unique(low, return_index=True, return_inverse=True)
        cells = np.stack([begins, high[back]], axis=1).ravel()
        return np.minimum.reduceat(np.append(self.owners, np.iinfo(np.int32).max), cells)[::2][number]
