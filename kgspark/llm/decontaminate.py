"""Benchmark items in documents, found by CGK embeddings and bit sampling, confirmed by edit distance.

Edits are of words: runs without white space, in lower case, without ASCII punctuation. A window the size of an item
with at most d edits, d a quarter of its words, leaves a run of ceil((n - d) / (d + 1)) words intact, so only windows
that share such a run with an item at the same place in both are looked at. The CGK walk reads a window's words one by
one, at each step moving on or staying by a random bit of the step and the word, and writes down what it reads; few
edits then leave most places equal. TRIES times SAMPLED places of that are compared, over several walks; a window
that agrees in all places of any try is aligned with the item word by word. Windows with fewer than n - d words of the item, as far
as a match may reach, are left out before; they can't align. d edits need not align by place: the window
is tried with its start shifted by up to SHIFTS words too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import rows_of, without
from kgspark.llm.shingles import BASE, LOWER, batches_of, hashes_at, mixed, sequence_hashes, words_at

#: Edits in hundredths of an item's words.
EDITS = 25
MIN_WORDS = 5
#: Walks, tries of each and places of a try. A window at a quarter of edits agrees in half of its places or so, and the
#: tries over all walks then miss it with a chance of (1 - 0.5**2) ** 48, about one in a million.
WALKS, TRIES, SAMPLED = 3, 16, 2
SHIFTS = 1
#: Words of windows that are looked at together.
TOGETHER = 600_000
SEED = 11
#: Characters of benchmark items that a pass over the documents holds in each task; more take more passes.
PASS_CHARS = 32 << 20
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, and their text."""
    raw = [(t or "").encode().translate(LOWER) for t in texts]
    a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    keep = ~PUNCTUATION[a]
    ends = np.concatenate(([0], np.cumsum(keep)))[ends]
    a = a[keep]
    start, end = words_at(a)
    return hashes_at(a, start, end), np.searchsorted(ends, start, "right")


def walk(words: np.ndarray, seeds: int, steps: int) -> np.ndarray:
    """What the first steps of CGK walks read: for each row of equally many words and each seed; past the end stands 0."""
    rows, n = words.shape
    padded = np.concatenate((words, np.zeros((rows, 1), np.uint64)), 1).ravel()
    first = np.repeat(np.arange(rows) * (n + 1), seeds).reshape(rows, seeds)
    at, out = np.zeros((rows, seeds), np.int64), np.empty((steps, rows, seeds), np.uint64)
    for j in range(steps):
        out[j] = now = padded[first + at]
        salt = np.array([int(BASE) * (j + 1 + 100_003 * seed) % (1 << 64) for seed in range(seeds)], np.uint64)
        at = np.minimum(n, at + (mixed(now + salt) & np.uint64(1)).astype(np.int64))
    return out


def samples(words: np.ndarray) -> np.ndarray:
    """For each row a hash for each try: of the sampled places of one of the walks."""
    n = words.shape[1]
    rng = np.random.default_rng(SEED + n)
    # places of the walk's first half: it reaches the end of the words at about two thirds
    places = np.array([rng.choice(2 * n, SAMPLED, replace=False) for _ in range(WALKS * TRIES)])
    embedded = walk(words, WALKS, int(places.max()) + 1)
    of = np.repeat(np.arange(WALKS), TRIES)
    key = np.zeros((len(places), len(words)), np.uint64)
    for j in places.T:
        key = mixed(key * BASE + embedded[j, :, of])
    return key.T


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the run of the window that takes fewest edits to become the item, the first and shortest such."""
    n = len(window)
    cost, start, steps = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for k, word in enumerate(item):
        via = np.empty(n + 1, np.int64)
        via[0] = k + 1
        via[1:] = np.minimum(cost[:-1] + (window != word), cost[1:] + 1)
        source = np.empty(n + 1, np.int64)
        source[0] = start[0]
        source[1:] = np.where(via[1:] == cost[:-1] + (window != word), start[:-1], start[1:])
        flat = via - steps
        best = np.minimum.accumulate(flat)
        # where a word of the window is left out, the start comes from the last place that set the best
        place = np.maximum.accumulate(np.where(flat == best, steps, 0))
        cost, start = best + steps, source[place]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Items:
    """Benchmark items: their words, the runs that find them, and their samples."""

    def __init__(self, rows: list[tuple[int, str | None]], edits: int = EDITS):
        words, of = plain_words([t for _, t in rows])
        cut = np.searchsorted(of, np.arange(len(rows) + 1))
        self.ids, self.words = [], []
        for k, (item, _) in enumerate(rows):
            if cut[k + 1] - cut[k] >= MIN_WORDS:
                self.ids.append(item)
                self.words.append(words[cut[k] : cut[k + 1]])
        self.most = [len(w) * edits // 100 for w in self.words]
        self.samples = [samples(w[None])[0] for w in self.words]
        self.runs = {}
        found: dict[int, list] = {}
        for k, w in enumerate(self.words):
            q = ceil((len(w) - self.most[k]) / (self.most[k] + 1))
            q = min(q, 5)
            found.setdefault(q, []).append((sequence_hashes(w, q), k))
        for q, runs in found.items():
            key = np.concatenate([h for h, _ in runs])
            item = np.concatenate([np.full(len(h), k) for h, k in runs])
            at = np.concatenate([np.arange(len(h)) for h, _ in runs])
            order = np.argsort(key, kind="stable")
            self.runs[q] = (key[order], item[order], at[order])
        self.known = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among all items' words, from 1; 0 if no item has it."""
        if not len(self.known):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at + 1, 0)

    def enough(self, its: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which windows (item, start), in order of items, hold enough words of their item to be it but for the allowed
        edits, looked at as far as a match may reach; the others can't align, so no match is lost."""
        ok = np.zeros(len(its), bool)
        held = np.zeros(len(self.known) + 1, bool)
        starts = np.flatnonzero(np.diff(its, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(its)], strict=True):
            k = its[a]
            n, d, own = len(self.words[k]), self.most[k], self.numbered(self.words[k])
            held[own] = True
            step = max(1, TOGETHER // n)
            for c in range(a, b, step):
                place = at[c : min(b, c + step), None] + np.arange(-d, n + d)
                inside = (place >= 0) & (place < len(number))
                ok[c : c + len(place)] = (held[number[np.clip(place, 0, len(number) - 1)]] & inside).sum(1) >= n - d
            held[own] = False
        return ok

    def places(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows that share a run with an item."""
        got = []
        for q, (key, item, at) in self.runs.items():
            if len(words) < q:
                continue
            h = sequence_hashes(words, q)
            slot = np.searchsorted(key, h)
            hit = np.flatnonzero((key[np.minimum(slot, len(key) - 1)] == h) & (of[: len(h)] == of[q - 1 :]))
            while len(hit):  # every item that has the run
                k = slot[hit]
                got.append((item[k], hit - at[k]))
                slot[hit] += 1
                hit = hit[slot[hit] < len(key)]
                hit = hit[key[slot[hit]] == h[hit]]
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.stack([np.concatenate(x) for x in zip(*got, strict=True)], 1), axis=0)
        return pair[:, 0], pair[:, 1]

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, words) of the best match of each item in each text, in words of the text."""
        words, of = plain_words(texts)
        item, start = self.places(words, of)
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        size = np.array([len(w) for w in self.words], np.int64)
        number = self.numbered(words)
        for n in np.unique(size[item]) if len(item) else ():
            own = size[item] == n
            its, at = item[own], start[own]
            its, at = np.repeat(its, 2 * SHIFTS + 1), (at[:, None] + np.arange(-SHIFTS, SHIFTS + 1)).ravel()
            its, at = np.unique(np.stack((its, at), 1), axis=0).T
            ok = self.enough(its, at, number)
            if not ok.any():
                continue
            its, at = its[ok], at[ok]
            mine = np.stack([self.samples[k] for k in its])
            padded = np.concatenate((words, np.zeros(n, np.uint64)))
            step = max(1, TOGETHER // int(n))
            for a in range(0, len(its), step):
                part = slice(a, a + step)
                window = padded[np.clip(at[part, None] + np.arange(n), 0, len(words))]
                like = np.flatnonzero((samples(window) == mine[part]).any(1)) + a
                for k, s in zip(its[like].tolist(), at[like].tolist(), strict=True):
                    d = self.most[k]
                    # the text of the window's middle: a window may hang over a text's ends by its edits
                    text = int(of[min(max(s + int(n) // 2, 0), len(words) - 1)])
                    for t in {text, int(of[min(max(s, 0), len(words) - 1)]), int(of[min(max(s + int(n) - 1, 0), len(words) - 1)])}:
                        lo, hi = max(s - d, int(first[t])), min(s + int(n) + d, int(first[t + 1]))
                        if hi - lo < n - d:
                            continue
                        cost, x, y = align(self.words[k], words[lo:hi])
                        if cost <= d:
                            have = (cost, lo + x - int(first[t]), y - x)
                            best[t, k] = min(best.get((t, k), have), have)
        return [(t, self.ids[k], *found) for (t, k), found in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, edits int, item_words int, start_word long, n_words long, similarity double"


def _match(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    size = dict(zip(items.ids, map(len, items.words), strict=True))
    for ids, texts in rows_of(batches, "doc_id", "text"):
        for a, b in batches_of(texts):
            rows = [(ids[a + t], i, e, size[i], s, n, 1 - e / max(size[i], n)) for t, i, e, s, n in items.matches(texts[a:b])]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row for each document and item where a passage is the item but for edits / 100 of its words at most.

    Columns: doc_id, item_id, edits, item_words, start_word and n_words of the best passage, similarity (1 - edits over
    the longer of both). Items of fewer than MIN_WORDS words, null texts among them, match nothing; an item_id that
    repeats counts once for each different text. Null and empty documents match nothing; rows that share a doc_id are
    searched one by one. Other columns are ignored; empty tables give no rows. Items are held whole by each task, in as
    many passes over the documents as their measured size takes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = max(1, ceil(chars / PASS_CHARS))
    found = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text")
        held = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in part.collect()], edits))
        found.append(docs.mapInArrow(lambda it, held=held: _match(it, held.value), SCHEMA))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    return without(docs, contaminated(docs, benchmark, edits).select("doc_id"), "doc_id")
