"""A wavelet matrix over token ids: one bit-plane per bit of an id, with rank and select, in one file."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WVMX0001"
#: Bits between two entries of a plane's rank directory.
STEP = 512
#: Ids that are moved at a time.
BLOCK = 1 << 15
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


class WaveletMatrix:
    """Access, rank, count and occurrences of ids, straight from the bit-planes."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks, self.levels = n, zeros, planes, ranks, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        """From ids below 2**levels. At each level, from the highest bit, ids with a 0 go stably before those with a 1."""
        x = np.ascontiguousarray(ids, np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, ranks = np.zeros(levels, np.int64), [], []
        for level in range(levels):
            bit = ((x >> (levels - 1 - level)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            counts = np.zeros(-(-len(packed) // (STEP // 8)) * (STEP // 8), np.uint16)
            counts[: len(packed)] = ONES[packed]
            ranks.append(np.concatenate(([0], np.cumsum(counts.reshape(-1, STEP // 8).sum(1, dtype=np.uint32)))).astype(np.uint32))
            planes.append(packed)
            zeros[level] = z = len(x) - np.count_nonzero(bit)
            y, low, high = np.empty_like(x), 0, z
            for a in range(0, len(x), BLOCK):  # places, in blocks that stay in the processor's cache, are much faster than masks
                part, ones = x[a : a + BLOCK], bit[a : a + BLOCK]
                up = np.flatnonzero(ones)
                y[high : high + len(up)] = part[up]
                y[low : low + len(part) - len(up)] = part[np.flatnonzero(~ones)]
                low, high = low + len(part) - len(up), high + len(up)
            x = y
        return cls(len(ids), zeros, planes, ranks)

    def bits(self, level: int) -> np.ndarray:
        """A plane as booleans."""
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit, z = self.bits(level), self.zeros[level]
            one, y, low, high = x.dtype.type(1 << (self.levels - 1 - level)), np.empty_like(x), 0, int(z)
            for a in range(0, len(x), BLOCK):
                part, ones = y[a : a + BLOCK], bit[a : a + BLOCK]
                up = np.flatnonzero(ones)
                part[up] = x[high : high + len(up)] | one
                part[np.flatnonzero(~ones)] = x[low : low + len(part) - len(up)]
                low, high = low + len(part) - len(up), high + len(up)
            x = y
        return x

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // STEP
        part = self.planes[level][block * STEP // 8 : -(-i // 8)]
        if not len(part):
            return int(self.ranks[level][block])
        spare = (-i) % 8
        last = int(part[-1]) & (0xFF >> spare)
        return int(self.ranks[level][block]) + int(ONES[part[:-1]].sum()) + int(ONES[last])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before `end` lie below the last plane."""
        if value >> self.levels or value < 0:
            return 0, 0
        a, b = 0, end
        for level in range(self.levels):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (int(self.zeros[level]) + x, int(self.zeros[level]) + y) if value >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id before position end."""
        a, b = self._range(value, end)
        return b - a

    def count(self, value: int) -> int:
        """Occurrences of an id."""
        return self.rank(value, self.n)

    def _select_bit(self, level: int, one: int, k: int) -> int:
        """The position of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not one:
            ranks = np.minimum(np.arange(len(ranks), dtype=np.int64) * STEP, self.n) - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        part = np.unpackbits(self.planes[level][block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")[: self.n - block * STEP]
        return block * STEP + int(np.flatnonzero(part == one)[k - int(ranks[block])])

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of an id."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            one = value >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, one, i - int(self.zeros[level]) * one)
        return i

    def dumps(self) -> bytes:
        """As bytes, little-endian: n, levels, zeros of each plane, then each plane's bits and its rank directory."""
        out = [struct.pack("<QI", self.n, self.levels), self.zeros.astype("<i8").tobytes()]
        for plane, rank in zip(self.planes, self.ranks, strict=True):
            out += [plane.tobytes(), rank.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def loads(cls, data: bytes, at: int = 0) -> WaveletMatrix:
        """From what dumps() gave; the planes are views of data."""
        n, levels = struct.unpack_from("<QI", data, at)
        at += 12
        zeros = np.frombuffer(data, "<i8", levels, at)
        at += 8 * levels
        size, planes, ranks = -(-n // 8), [], []
        steps = -(-size // (STEP // 8)) + 1
        for _ in range(levels):
            planes.append(np.frombuffer(data, np.uint8, size, at))
            ranks.append(np.frombuffer(data, "<u4", steps, at + size))
            at += size + 4 * steps
        return cls(n, zeros, planes, ranks)


def dump_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    """A file: magic, number of documents, their ids and whether they are null, their lengths, the matrix."""
    head = [MAGIC, struct.pack("<Q", len(doc_ids))]
    head.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    head.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    head.append(np.asarray(lengths, "<i8").tobytes())
    return b"".join([*head, WaveletMatrix.build(ids, levels).dumps()])


def load_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the matrix of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack_from("<Q", data, 8)
    ids = np.frombuffer(data, "<i8", n, 16).tolist()
    null = np.frombuffer(data, np.uint8, n, 16 + 8 * n)
    lengths = np.frombuffer(data, "<i8", n, 16 + 9 * n)
    return [None if z else i for i, z in zip(ids, null, strict=True)], lengths, WaveletMatrix.loads(data, 16 + 17 * n)
