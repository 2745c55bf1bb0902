"""Hashes of all words of many texts at once, by prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Classes of bytes: 0 stands between words, a run of another class is a word, and in class SINGLE every byte is one.
SINGLE = 2
#: Words of digits, a to z, and every byte of a character beyond ASCII.
WORD = np.zeros(256, dtype=np.int8)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(*hashes: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash for each tuple of hashes, in their order."""
    total = np.full(hashes[0].shape, salt + 1, dtype=np.uint64)
    for h in hashes:
        total = mix(total * np.uint64(BASE) + h)
    return total


class Words:
    """The words of a list of lower-cased texts: hash, text number, and byte offsets in that text."""

    def __init__(self, texts: list[bytes], classes: np.ndarray = WORD):
        raw = b"\n".join(texts) + b"\n"
        buffer = np.frombuffer(raw, dtype=np.uint8)
        kinds = classes[buffer]
        turn = np.empty(buffer.size, dtype=bool)
        turn[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=turn[1:])
        if (classes == SINGLE).any():
            turn |= kinds == SINGLE
        turns = np.append(np.flatnonzero(turn), buffer.size)
        full = kinds[turns[:-1]] != 0
        starts, ends = turns[:-1][full], turns[1:][full]
        self.raw, self.from_, self.to = raw, starts, ends
        up = np.full(buffer.size + 1, BASE, dtype=np.uint64)
        down = np.full(buffer.size + 1, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        sums = np.zeros(buffer.size + 1, dtype=np.uint64)
        # In place, as these arrays are what takes most of a worker's memory.
        sums[1:] = buffer
        sums[1:] += np.uint64(1)
        sums[1:] *= up[:-1]
        del up
        np.cumsum(sums[1:], out=sums[1:])
        self.hash = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.text = np.searchsorted(bounds, starts, side="right") - 1
        self.start, self.end = starts - bounds[self.text], ends - bounds[self.text]
        #: The number of the first word of each text, and the number of all words at the end.
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def grams(self, offsets: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of each tuple of words at these ascending offsets from 0 that lies within one text."""
        n = self.hash.size - offsets[-1]
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[offsets[-1] :])
        return at, chain(*(self.hash[at + o] for o in offsets), salt=salt)

    @property
    def units(self) -> np.ndarray:
        """All texts' bytes, in which `from_` and `to` are places."""
        return np.frombuffer(self.raw, dtype=np.uint8)

    def spelled(self, numbers: np.ndarray) -> list[bytes]:
        """The bytes of these words."""
        return [self.raw[a:b] for a, b in zip(self.from_[numbers].tolist(), self.to[numbers].tolist(), strict=True)]


class Lexicon:
    """Row numbers of 64-bit hashes, in the order in which they were added: an open-addressed table in arrays, for many lookups at once."""

    def __init__(self, log2: int = 16):
        self.log2, self.size = log2, 0
        self.keys, self.rows = np.zeros(1 << log2, dtype=np.uint64), np.full(1 << log2, -1, dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        out, left = np.full(hashes.size, -1, dtype=np.int64), np.arange(hashes.size)
        slot = (hashes >> np.uint64(64 - self.log2)).astype(np.int64)
        key = hashes
        while left.size:
            row = self.rows[slot]
            hit = (self.keys[slot] == key) & (row >= 0)
            out[left[hit]] = row[hit]
            on = ~hit & (row >= 0)
            left, slot, key = left[on], (slot[on] + 1) & ((1 << self.log2) - 1), key[on]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Give the next rows to distinct hashes that are not in the table yet."""
        while (self.size + hashes.size) * 2 > 1 << self.log2:
            old = self.rows >= 0
            keys, rows = self.keys[old], self.rows[old]
            self.log2 += 1
            self.keys, self.rows = np.zeros(1 << self.log2, dtype=np.uint64), np.full(1 << self.log2, -1, dtype=np.int64)
            self._put(keys, rows)
        self._put(hashes, np.arange(self.size, self.size + hashes.size))
        self.size += hashes.size

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = (keys >> np.uint64(64 - self.log2)).astype(np.int64)
        while keys.size:
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rows[free]
            won = self.rows[slot] == rows
            self.keys[slot[won]] = keys[won]
            lost = ~won
            keys, rows, slot = keys[lost], rows[lost], (slot[lost] + 1) & ((1 << self.log2) - 1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges that follow each other, as one array."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Spellings:
    """A lexicon whose rows are known by their letters: a hash finds a row, and the letters, once compared, confirm it.

    Words whose hashes meet get another hash each, as often as it takes, so that every word has a row of its own.
    """

    def __init__(self, dtype: type):
        self.lexicon, self.dtype = Lexicon(), dtype
        self.hashes, self.ends, self.units = np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.empty(1 << 16, dtype=dtype)

    @property
    def size(self) -> int:
        return self.lexicon.size

    def _add(self, hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        total, have = int(sizes.sum()), int(self.ends[-1])
        if have + total > self.units.size:
            self.units = np.concatenate([self.units[:have], np.empty((have + total) // 2 + total, dtype=self.dtype)])
        self.units[have : have + total] = units[ranges(starts, sizes)]
        self.ends = np.concatenate([self.ends, have + np.cumsum(sizes)])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.lexicon.add(hashes)

    def _same(self, rows: np.ndarray, units: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each range of units, none empty, is spelled as its row."""
        same = self.ends[rows + 1] - self.ends[rows] == sizes
        at = np.flatnonzero(same)
        for i in range(0, at.size, 1 << 17):
            some = at[i : i + (1 << 17)]
            size = sizes[some]
            equal = self.units[ranges(self.ends[rows[some]], size)] == units[ranges(starts[some], size)]
            same[some] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return same

    def rows(self, hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[np.ndarray], None]) -> np.ndarray:
        """The row of each word, given as a range of units with its hash. New words get the next rows, in the order in which `learn` is told their numbers."""
        row, left, sizes, h = np.empty(hashes.size, dtype=np.int64), np.arange(hashes.size), ends - starts, hashes
        while left.size:
            found = self.lexicon.find(h)
            if (new := np.flatnonzero(found < 0)).size:
                unique, at = np.unique(h[new], return_index=True)
                chosen = left[new[at]]
                learn(chosen)
                self._add(unique, units, starts[chosen], sizes[chosen])
                found = self.lexicon.find(h)
            same = self._same(found, units, starts[left], sizes[left])
            row[left] = found
            left, h = left[~same], mix(h[~same] + np.uint64(1))
        return row

    def kept(self, rows: np.ndarray) -> Spellings:
        """A lexicon of these rows alone, in this order."""
        out = Spellings(self.dtype)
        out._add(self.hashes[rows], self.units, self.ends[rows], self.ends[rows + 1] - self.ends[rows])
        return out
