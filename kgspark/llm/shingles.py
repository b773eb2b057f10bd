"""Words and word shingles as 64-bit hashes, computed with numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WIDTH = 5
#: Bytes that are hashed at a time; what is kept for a worker's life is in proportion to it, not to the longest text.
BLOCK = 1 << 18
#: Characters of texts that are worked on together.
TOGETHER = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n at least; n is bounded by a constant in every use."""
    have = _powers.get("n", 0)
    if have <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_at(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start and end (exclusive)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[a], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def hashes_at(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A uint64 for each of the words of some bytes, which may cross blocks."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = min(len(a), BLOCK)
    up, down = powers(size)
    up, total = up[:size], np.zeros(size + 1, np.uint64)
    out = np.empty(len(start), np.uint64)
    scale, carry = np.uint64(1), np.uint64(0)  # BASE**at, and the sum before the block
    step, unstep = int(up[-1]) * int(BASE) % (1 << 64), pow(int(BASE), -size, 1 << 64)
    first = last = 0
    for at in range(0, len(a), size):
        n = min(size, len(a) - at)
        np.cumsum((a[at : at + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1 : n + 1])
        ends = last + int(np.searchsorted(end[last:], at + n, "right"))
        starts = first + int(np.searchsorted(start[first:], at + n, "left"))
        if at == 0 and n == len(a):
            return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        own = start[first:starts] - at
        out[first:starts] = carry + scale * total[own]
        # a word's sum is what its end has more than its start; both are kept until the word has ended
        done = slice(last, ends)
        out[done] = (carry + scale * total[end[done] - at]) - out[done]
        first, last = starts, ends
        carry = np.uint64((int(carry) + int(scale) * int(total[n])) % (1 << 64))
        scale = np.uint64(int(scale) * step % (1 << 64))
    block, off = np.divmod(start, size)
    shift = np.array([pow(unstep, k, 1 << 64) for k in range(int(block[-1]) + 1)], np.uint64)
    return mixed(out * shift[block] * down[off] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A uint64 for each word of a text; A-Z are lower-cased, words are runs of other than 0x20 and 0x09-0x0D."""
    a = np.frombuffer((text or "").encode().translate(LOWER), np.uint8)
    return hashes_at(a, *words_at(a))


def sequence_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for every run of `width` words; fewer words make one run, none make none."""
    if not len(words):
        return words
    n = min(width, len(words))
    weight = mixed(np.arange(1, width + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    last = len(words) - n + 1
    total = np.full(last, n, np.uint64)
    for j in range(n):
        total += words[j : j + last] * weight[j]
    return mixed(total)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, sorted as signed 64-bit integers."""
    return np.unique(sequence_hashes(word_hashes(text)).view(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


#: Every letter as one class, every digit as another; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48


def batches_of(texts: list[str | None], size: int = TOGETHER) -> list[tuple[int, int]]:
    """Ranges of texts that hold some `size` characters each, or one longer text."""
    out, at, held = [], 0, 0
    for k, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= size:
            out.append((at, k + 1))
            at, held = k + 1, 0
    return [*out, (at, len(texts))] if at < len(texts) else out


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of several texts: their hashes, the hashes of their shapes (runs of a class count once), their text."""
    raw = [(t or "").encode() for t in texts]
    a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    first = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))[:-1]
    start, end = words_at(a)
    of = np.searchsorted(first, start, "right") - 1
    words = hashes_at(np.frombuffer(LOWER, np.uint8)[a], start, end)
    shape = SHAPE[a]
    again = np.concatenate(([False], shape[1:] == shape[:-1])) & ((shape == 65) | (shape == 97) | (shape == 48))
    shape = shape[~again]
    return words, hashes_at(shape, *words_at(shape)), of
