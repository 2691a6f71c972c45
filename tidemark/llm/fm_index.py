"""A bidirectional FM-index over delimited words, asked for many words at once.

The words stand in one cyclic text, each behind a delimiter. One half of the index ranks the text's rotations, the
other those of the reversed text. An interval of ranks in one half is kept in step with the other half's interval, so
a match may grow to the left for a while and then to the right. All queries of a call have one length and move
through the index together, as arrays.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0
#: What a text word has in the place of a query's exact letters.
REPLACED, ADDED, DROPPED = 0, 1, -1


def rotations(codes: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of the cyclic text's rotations in their order: several codes packed, then doubled."""
    size, width = len(codes), max(1, 62 // bits)
    key = np.zeros(size, np.int64)
    for step in range(width):
        key = key << bits | np.roll(codes, -step)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == size - 1:
            return order
        key = rank * size + np.roll(rank, -width)
        width *= 2


class Ranks:
    """Counts of codes before a position, as a wavelet matrix: one array of running counts for each bit."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (codes >> shift) & 1
            ones = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(codes) - int(ones[-1])))
            codes = np.concatenate((codes[bit == 0], codes[bit == 1]))

    def narrow(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bounds of `code` among the positions low..high in the last level's order, and how many codes are smaller."""
        smaller = np.zeros(len(low), np.int64)
        for shift, ones, zeros in self.levels:
            one = (code >> shift & 1).astype(bool)
            a, b = ones[low], ones[high]
            smaller += np.where(one, (high - low) - (b - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return low, high, smaller

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each code that occurs in an interval: number of the interval, code, bounds as in `narrow`."""
        number, code = np.arange(len(low)), np.zeros(len(low), np.int64)
        for _, ones, zeros in self.levels:
            a, b = ones[low], ones[high]
            none, some = high - b > low - a, b > a
            number = np.concatenate((number[none], number[some]))
            code = np.concatenate((code[none] << 1, code[some] << 1 | 1))
            low, high = (
                np.concatenate(((low - a)[none], zeros + a[some])),
                np.concatenate(((high - b)[none], zeros + b[some])),
            )
        return number, code, low, high


class Half:
    """Ranked rotations of a text, and how their interval changes when a code is put before a match."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.order = rotations(codes, bits)
        self.ranks = Ranks(codes[self.order - 1], bits)
        counts = np.bincount(codes, minlength=1 << bits)
        every, start = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        self.shift = np.cumsum(counts) - counts - self.ranks.narrow(start, start, every)[0]

    def extend(self, low: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """The interval's new start and size, and what the other half's start moves by."""
        first, last, smaller = self.ranks.narrow(low, low + size, code)
        return first + self.shift[code], last - first, smaller

    def children(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        number, code, first, last = self.ranks.children(low, low + size)
        return number, code, first + self.shift[code], last - first


State = tuple[np.ndarray, np.ndarray, np.ndarray]


def _joined(*states: State) -> State:
    return tuple(np.concatenate(parts) for parts in zip(*states, strict=True))


def _stepped(half: Half, state: State, codes: np.ndarray) -> State:
    """States (query, start, size) that still match when each is extended by its query's code."""
    who, low, size = state
    low, size, _ = half.extend(low, size, codes[who])
    keep = size > 0
    return who[keep], low[keep], size[keep]


class FmIndex:
    """Index of distinct words without the delimiter character; not empty."""

    def __init__(self, words: list[str]) -> None:
        points = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), "<u4")
        self.alphabet, codes = np.unique(points, return_inverse=True)
        codes = codes.astype(np.int64)
        #: One code beyond the alphabet's stands for characters that no word has.
        self.bits = len(self.alphabet).bit_length()
        self.count, self.size = len(words), len(codes)
        self.starts = np.flatnonzero(codes == DELIMITER)
        self.left, self.right = Half(codes, self.bits), Half(codes[::-1].copy(), self.bits)

    def codes(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of codes."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.int64)

    def near(self, words: list[str], kind: int, first_half_exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word of the index) that differ by one code of `kind`, which lies in the other half.

        The exact half is matched from the middle to the word's end, there the search turns round and extends
        across the other half. A pair whose error can be placed in several ways is given once here, but both
        searches may give it if the places lie on both sides of the middle.
        """
        codes = self.codes(words)
        half = codes.shape[1] // 2
        border = np.full((len(words), 1), DELIMITER)
        front, back = codes[:, :half][:, ::-1], codes[:, half:]
        if first_half_exact:
            first, second, exact, rest = self.left, self.right, front, back
        else:
            first, second, exact, rest = self.right, self.left, back, front
        state = self._exact(first, np.hstack((exact, border)))
        who, low, size = self._one_error(second, state, np.hstack((rest, border)), kind)
        at = second.order[low]
        if first_half_exact:  # of the reversed text: the delimiter behind the word
            return who, (np.searchsorted(self.starts, self.size - 1 - at) - 1) % self.count
        return who, np.searchsorted(self.starts, at)

    def _exact(self, half: Half, codes: np.ndarray) -> State:
        """Queries whose codes match, with their interval in the other half."""
        who = np.arange(len(codes))
        low, other, size = (np.full(len(codes), n, np.int64) for n in (0, 0, self.size))
        for column in codes.T:
            low, size, smaller = half.extend(low, size, column[who])
            keep = size > 0
            who, low, other, size = who[keep], low[keep], (other + smaller)[keep], size[keep]
        return who, other, size

    def _one_error(self, half: Half, exact: State, codes: np.ndarray, kind: int) -> State:
        """Extends by `codes`, the last of which is the delimiter, with exactly one error before it."""
        erred: State = tuple(np.zeros(0, np.int64) for _ in range(3))
        last = codes.shape[1] - 1
        for at, column in enumerate(codes.T):
            who, low, size = exact
            fresh: State = tuple(x[:0] for x in exact)
            if kind == DROPPED:
                if at < last:  # of equal letters in a row, the last is the one left out
                    keep = column[who] != codes[who, at + 1]
                    fresh = who[keep], low[keep], size[keep]
            elif kind == ADDED or at < last:
                number, code, start, count = half.children(low, size)
                keep = (code != DELIMITER) & (code != column[who[number]])
                fresh = who[number][keep], start[keep], count[keep]
            if kind == ADDED:
                erred = _stepped(half, _joined(erred, fresh), column)
            else:
                erred = _joined(_stepped(half, erred, column), fresh)
            exact = _stepped(half, exact, column)
        return erred
