"""FM-index of a sequence of word numbers: suffix order, wavelet matrix of the last column, sampled suffix positions.

The sequence holds several documents, each closed by the number 1, and ends with one 0. Backward search narrows a range of
sorted suffixes word by word, from the last word of a phrase to the first, by two ranks in the wavelet matrix. A row of
that range is located by stepping back through the text until a sampled position is met. Many phrases, and many rows, move together.
"""

from __future__ import annotations

import numpy as np

from .common import joined, parted, squeeze, unsqueeze

#: Every so many-th position of the sequence is sampled.
SAMPLE = 16
END, BREAK = 0, 1


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a sequence in ascending order. The last member is the only 0.

    Several words are packed into one number and sorted; then ranks of equal suffixes are packed in the same
    way, so each round compares three or more times as many words, and only suffixes that are still equal to others take part.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    packed = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    wide = np.concatenate([text.astype(np.int64), np.zeros(packed, np.int64)])
    for j in range(packed):
        key = (key << bits) | wide[j : j + n]
    order = np.argsort(key)
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # The rank of a suffix is the first slot of its equals.
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = starts
    alone = first & np.concatenate([first[1:], [True]])
    slots = np.flatnonzero(~alone)
    known, bits = packed, max(1, n.bit_length())
    packed = max(2, 62 // bits)
    while len(slots):
        places = order[slots]
        key = rank[places]
        for j in range(1, packed):
            key = (key << bits) | rank[np.minimum(places + j * known, n - 1)]
        again = np.argsort(key)
        places, key = places[again], key[again]
        order[slots] = places
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[places] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        slots = slots[~(first & np.concatenate([first[1:], [True]]))]
        known *= packed
    return order


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        padded = np.zeros(-(-(len(flags) + 1) // 64) * 64, dtype=bool)
        padded[: len(flags)] = flags
        return cls(np.packbits(padded, bitorder="little").view(np.uint64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Ranks of any symbol in a sequence: one bit vector for each bit of the symbols, the highest first."""

    def __init__(self, levels: list[Bits], zeros: list[int]):
        self.levels, self.zeros = levels, zeros

    @classmethod
    def of(cls, symbols: np.ndarray, bits: int) -> Wavelet:
        levels, zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            levels.append(Bits.of(ones))
            left = symbols[~ones]
            zeros.append(len(left))
            symbols = np.concatenate([left, symbols[ones]])
        return cls(levels, zeros)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place; `at` may have several rows of places."""
        start, bits = np.zeros(len(symbols), dtype=np.int64), len(self.levels)
        for i, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbols >> (bits - 1 - i) & 1).astype(bool)
            ones, from_start = level.rank(at), level.rank(start)
            at = np.where(one, zeros + ones, at - ones)
            start = np.where(one, zeros + from_start, start - from_start)
        return at - start

    def symbols_and_ranks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        start, symbol = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(at)
            ones, from_start = level.rank(at), level.rank(start)
            at = np.where(one, zeros + ones, at - ones)
            start = np.where(one, zeros + from_start, start - from_start)
            symbol = symbol << 1 | one
        return symbol, at - start


class FMIndex:
    """Counts and finds phrases of word numbers (2 and up)."""

    def __init__(self, size: int, counts: np.ndarray, wavelet: Wavelet, marks: Bits, samples: np.ndarray):
        self.size, self.counts, self.wavelet, self.marks, self.samples = size, counts, wavelet, marks, samples

    @classmethod
    def of(cls, text: np.ndarray) -> FMIndex:
        order = suffix_order(text)
        last = text[order - 1].astype(np.int32)  # of the first place, the 0 at the end
        top = int(text.max())
        counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        sampled = order % SAMPLE == 0
        return cls(len(text), counts, Wavelet.of(last, max(1, top.bit_length())), Bits.of(sampled), order[sampled])

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of the sorted suffixes that start with each phrase; phrases are rows of one length."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[alive, j]
            ends = self.counts[symbols] + self.wavelet.rank(symbols, np.stack([low[alive], high[alive]]))
            low[alive], high[alive] = ends
            alive = alive[ends[0] < ends[1]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each row of the sorted suffixes."""
        found, steps, pending, at = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows)), rows
        while len(pending):
            marked = self.marks.get(at)
            found[pending[marked]] = self.samples[self.marks.rank(at[marked])] + steps
            pending, at = pending[~marked], at[~marked]
            symbols, ranks = self.wavelet.symbols_and_ranks(at)
            at, steps = self.counts[symbols] + ranks, steps + 1
        return found

    def dump(self) -> bytes:
        head = np.array([self.size, len(self.wavelet.levels), *self.wavelet.zeros], dtype=np.int64)
        return joined([head.tobytes(), squeeze(self.counts.astype(np.int64)), *(b.words.tobytes() for b in (*self.wavelet.levels, self.marks)), squeeze(self.samples.astype(np.int64))])

    @classmethod
    def load(cls, data: bytes) -> FMIndex:
        head, counts, *bits, samples = parted(data)
        numbers = np.frombuffer(head, dtype=np.int64)
        vectors = [Bits(np.frombuffer(b, dtype=np.uint64)) for b in bits]
        wavelet = Wavelet(vectors[:-1], numbers[2:].tolist())
        return cls(int(numbers[0]), unsqueeze(counts, "int64"), wavelet, vectors[-1], unsqueeze(samples, "int64"))
