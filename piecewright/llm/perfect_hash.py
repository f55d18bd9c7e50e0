"""A minimal perfect hash over 64-bit hashes, built level by level with numpy."""

from __future__ import annotations

import io

import numpy as np

_MULTIPLIER, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(33))) + np.uint64(level + 1) * _STEP
        x *= _MULTIPLIER
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Maps each of n distinct hashes to its own number below n; other hashes to any number, or to -1.

    Each level places the hashes that get a bit of their own among `spread` bits per hash and hands the others on. What
    no level can place is kept sorted and looked up by binary search.
    """

    LEVELS = 24

    def __init__(self, bits: list[np.ndarray], sizes: np.ndarray, rest: np.ndarray):
        self.bits, self.sizes, self.rest = bits, sizes, rest
        self.before, base = [], 0
        for words in bits:
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.before.append(base + np.concatenate(([0], counts[:-1])))
            base += int(counts[-1])
        self.placed = base

    @classmethod
    def build(cls, hashes: np.ndarray, spread: float = 2.0) -> PerfectHash:
        left, bits, sizes = np.unique(hashes), [], []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(len(left) * spread) // 64) * 64)
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            sizes.append(size)
            left = left[~alone[at]]
        return cls(bits, np.array(sizes, np.int64), left)

    def __len__(self) -> int:
        return self.placed + len(self.rest)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (words, before, size) in enumerate(zip(self.bits, self.before, self.sizes.tolist())):
            if not len(open_):
                return out
            at = (_mixed(hashes[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            near = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            same = self.rest[near] == hashes[open_]
            out[open_[same]] = self.placed + near[same]
        return out


class LineShard:
    """One shard of the line table: a perfect hash and the arrays that it indexes."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.index, self.prints, self.counts, self.last = index, prints, counts, last

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineShard:
        index = PerfectHash.build(h1)
        at = index.find(h1)
        made = [np.zeros(len(index), kind) for kind in ("u8", "i8", "i8")]
        for array, values in zip(made, (h2, counts, last)):
            array[at] = values
        return cls(index, *made)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.index.sizes, rest=self.index.rest, prints=self.prints, counts=self.counts, last=self.last, words=np.concatenate([*self.index.bits, np.zeros(0, "u8")]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineShard:
        with np.load(io.BytesIO(data)) as z:
            ends = np.cumsum(z["sizes"] // 64)
            bits = np.split(z["words"], ends[:-1]) if len(ends) else []
            return cls(PerfectHash(list(bits), z["sizes"], z["rest"]), z["prints"], z["counts"], z["last"])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each hash: whether its line is in the table, and if so its count and its largest document."""
        at = self.index.find(h1)
        known = at >= 0
        if not len(self.prints):
            return np.zeros(len(h1), bool), at, at
        known &= self.prints[at] == h2
        return known, np.where(known, self.counts[at], 0), np.where(known, self.last[at], 0)
