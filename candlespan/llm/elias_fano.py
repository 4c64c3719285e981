"""Elias-Fano sequences and an n-gram trie of them.

A sorted sequence of n numbers below u takes about 2 + log2(u / n) bits each: the low bits are packed, the high parts are a
bit vector in which each number is a one and each step of the high part a zero. All arrays lie in one buffer, which may be a mapped
file.

A trie level holds its nodes as numbers `parent * V + word`, in order, so the successors of a context are a range: pointers, another
monotone sequence, say where it starts, and a word is found by a successor search from the context's base.
"""

from __future__ import annotations

import json

import numpy as np


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._starts: np.ndarray | None = None
        # eight bytes from any byte on
        self._words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Of sorted values below `universe` (at most 2 ** 64); equal values may repeat."""
        values = values.astype(np.uint64)
        n = len(values)
        # eight bytes from a byte border hold 57 bits at any offset; sparser sequences have a longer bit vector instead
        bits = min(57, max(0, (universe // max(n, 1)).bit_length() - 1))
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        for start in range(0, n, 1 << 16):  # a multiple of eight values, so whole bytes
            part = values[start : start + (1 << 16)]
            spread = (part[:, None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(spread.ravel(), bitorder="little")
            low[start * bits // 8 : start * bits // 8 + len(packed)] = packed
        top = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros(n + int((universe - 1) >> bits if universe else 0) + 2, np.uint8)
        flags[top + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"))

    def _directory(self) -> np.ndarray:
        """For each high part the number of values below it, worked out from the bit vector when first needed."""
        if self._starts is None:
            zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
            self._starts = np.minimum(np.append(0, zeros - np.arange(len(zeros))), self.n)
        return self._starts

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        return self._words[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits) | self._low(np.arange(self.n))

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that is at least x (n if there is none), and whether it equals x."""
        x = x.astype(np.uint64)
        starts, top = self._directory(), (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = top < len(starts) - 1
        top = np.minimum(top, len(starts) - 2)
        lo, end = starts[top], starts[top + 1]
        lo = np.where(inside, lo, self.n)
        hi = np.where(inside, end, self.n)
        end, low = hi.copy(), x & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        equal = lo < end
        at = np.flatnonzero(equal)
        equal[at] = self._low(lo[at]) == low[at]
        return lo, equal


class Trie:
    """Levels of (keys, pointers to the next level, values); the buffer made by `pack` is opened again without copying."""

    def __init__(self, words: EliasFano, levels: list[dict]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]) -> Trie:
        """`words`: sorted word hashes (64 bits). Each level: the parents (all 0 at the first one), word numbers, and values; sorted
        by parent and word, without repeats."""
        size, made, n_parents = max(1, len(words)), [], 1
        for parents, ids, values in levels:
            keys = parents.astype(np.uint64) * np.uint64(size) + ids.astype(np.uint64)
            starts = np.searchsorted(parents, np.arange(n_parents + 1))
            made.append({
                "keys": EliasFano.build(keys, n_parents * size), "pointers": EliasFano.build(starts, len(parents) + 1), "values": values,
            })
            n_parents = max(1, len(parents))
        return cls(EliasFano.build(words, 1 << 64), made)

    def pack(self) -> bytes:
        head, parts, at = [], [], 0

        def put(a: np.ndarray) -> list:
            nonlocal at
            raw = np.ascontiguousarray(a).tobytes()
            place = [at, len(a), a.dtype.str]
            parts.append(raw + b"\0" * (-len(raw) % 8))
            at += len(parts[-1])
            return place

        fano = lambda e: [e.n, e.low_bits, put(e.low), put(e.high)]
        for level in self.levels:
            head.append([fano(level["keys"]), fano(level["pointers"]), {k: put(v) for k, v in level["values"].items()}])
        text = json.dumps([fano(self.words), head]).encode()
        text += b" " * (-len(text) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(parts)

    @classmethod
    def open(cls, buffer) -> Trie:
        view = memoryview(buffer)
        size = int.from_bytes(view[:8], "little")
        words, head = json.loads(bytes(view[8 : 8 + size]))
        get = lambda p: np.frombuffer(view, p[2], p[1], 8 + size + p[0])
        fano = lambda f: EliasFano(f[0], f[1], get(f[2]), get(f[3]))
        return cls(fano(words), [{"keys": fano(k), "pointers": fano(p), "values": {n: get(v) for n, v in vs.items()}} for k, p, vs in head])

    def word(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of word hashes, -1 for unknown ones."""
        at, known = self.words.successor(hashes)
        return np.where(known, at, -1)

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of a level below the given ones of the level before (0 at the first level), -1 where there is none."""
        ok = np.flatnonzero((parent >= 0) & (word >= 0))
        out = np.full(len(word), -1, np.int64)
        if len(ok) and (keys := self.levels[level]["keys"]).n:
            x = parent[ok].astype(np.uint64) * np.uint64(max(1, self.words.n)) + word[ok].astype(np.uint64)
            at, found = keys.successor(x)
            out[ok[found]] = at[found]
        return out

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the range of each parent's nodes in a level."""
        starts = self.levels[level]["pointers"].values().astype(np.int64)
        return starts[:-1], starts[1:]
