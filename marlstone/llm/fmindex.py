"""An FM-index over words: which rows of a suffix array begin with a phrase, and where in the text those rows lie.

A text collection is a row of numbers: words from 1 on, and a 0 at the end of each text. Suffixes are sorted; the words
before them, in that order, are kept in a wavelet matrix, whose ranks lead a phrase from its last word to its first
(backward search). Every eighth position and every beginning of a text is kept as a sample; from any other row, steps back
through the text lead to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every so-many-th position is kept as a sample.
STEP = 8


def ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from low to high of each range, one after the other, and the range that each is of."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which], which


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that begin there. The zeros of ``x`` count as different, by place, and one ends it.

    The first sort is by as many symbols as fit into 62 bits; after that the sorted length doubles, and only suffixes that are
    still alike are sorted again.
    """
    n = len(x)
    ends = np.flatnonzero(x == 0)
    own = x.astype(np.int64) + (len(ends) - 1)
    own[ends] = np.arange(len(ends))
    bits = max(1, int(own.max(initial=1)).bit_length())
    width = max(1, min(n, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= own[k:]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, bool)
    # The rank of a suffix is the first row of those that are like it so far.
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = first
    alike = np.flatnonzero(~(fresh & np.r_[fresh[1:], True])) if n else np.zeros(0, np.int64)
    while len(alike):
        at = order[alike]
        # Suffixes that are alike hold no end in the part sorted so far, so at + width lies inside.
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[alike] = at
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[at] = alike[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        alike = alike[~(fresh & np.r_[fresh[1:], True])]
        width *= 2
    return order


@dataclass
class Bits:
    """A row of bits with the number of ones before each word of 64."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        return cls(words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.uint32)[:-1]].astype(np.uint32))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


@dataclass
class FMIndex:
    """See the module. ``starts[c]``: the first row of the suffixes that begin with symbol c."""

    levels: list[Bits]
    zeros: np.ndarray
    starts: np.ndarray
    marked: Bits
    samples: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray) -> FMIndex:
        """Index of a row of numbers that ends with 0."""
        order = suffix_array(x)
        symbols = int(x.max(initial=0)) + 1
        before = x[order - 1]  # what lies before the whole is the last 0
        levels, zeros, line = [], [], before
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = (line >> shift) & 1 != 0
            levels.append(Bits.of(bit))
            line = np.concatenate([line[~bit], line[bit]])
            zeros.append(len(bit) - int(np.count_nonzero(bit)))
        sampled = (order % STEP == 0) | (before == 0)
        starts = np.r_[0, np.cumsum(np.bincount(x, minlength=symbols))]
        return cls(levels, np.array(zeros, np.int64), starts, Bits.of(sampled), order[sampled].astype(np.int32))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` rows have ``symbol`` before their suffix."""
        low = np.zeros_like(at)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (symbol >> (len(self.levels) - 1 - k)) & 1 != 0
            a, b = level.ones(low), level.ones(at)
            low, at = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, at - b)
        return at - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one row of the suffixes that begin with each phrase: a row of ``phrases``, its words at the left, -1: none such here."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.starts[-1], np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < lengths) & (low < high))
            symbol = phrases[live, k]
            known = (symbol > 0) & (symbol < len(self.starts) - 1)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known].astype(np.int64)
            if len(live):
                first = self.starts[symbol]
                both = self.rank(np.r_[symbol, symbol], np.r_[low[live], high[live]])
                low[live], high[live] = first + both[: len(live)], first + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in some rows: steps back until a sampled row."""
        found = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.marked.get(at)
            found[left[hit]] = self.samples[self.marked.ones(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            symbol, place, base = np.zeros_like(at), at, np.zeros_like(at)
            for level, zeros in zip(self.levels, self.zeros, strict=True):
                bit, a, b = level.get(place), level.ones(place), level.ones(base)
                place, base = np.where(bit, zeros + a, place - a), np.where(bit, zeros + b, base - b)
                symbol = symbol * 2 + bit
            at, steps = self.starts[symbol] + place - base, steps + 1
        return found

    def dump(self) -> dict[str, bytes]:
        """The parts as bytes, for storage."""
        return {
            "bits": b"".join(x.words.tobytes() for x in (*self.levels, self.marked)),
            "ranks": b"".join(x.before.tobytes() for x in (*self.levels, self.marked)),
            "zeros": self.zeros.tobytes(),
            "starts": self.starts.astype(np.int64).tobytes(),
            "samples": self.samples.tobytes(),
        }

    @classmethod
    def load(cls, parts: dict[str, bytes]) -> FMIndex:
        """What :meth:`dump` has written."""
        zeros = np.frombuffer(parts["zeros"], np.int64)
        words = np.frombuffer(parts["bits"], "<u8").reshape(len(zeros) + 1, -1)
        before = np.frombuffer(parts["ranks"], np.uint32).reshape(len(zeros) + 1, -1)
        *levels, marked = [Bits(w, b) for w, b in zip(words, before, strict=True)]
        return cls(levels, zeros, np.frombuffer(parts["starts"], np.int64), marked, np.frombuffer(parts["samples"], np.int32))
