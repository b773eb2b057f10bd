"""Token ids of documents as wavelet-matrix files, one per shard, and the way back.

Documents are dealt by ranges of doc_id. Each task encodes its range and writes shards of a bounded number of tokens to
the shared folder; a table of the files that finished tasks wrote is the manifest, so a lost executor's half-written or
repeated files are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import filesystem, rows_of, shared_dir, staged, write_file
from kgspark.llm.shingles import LOWER, batches_of, hashes_at, words_at
from kgspark.llm.wavelet import dump_shard, load_shard

SHARD_TOKENS = 1 << 22
END_ID = 1
#: Signs that often stand beside a word.
SIGNS = ".,;:!?*#$%&"
#: Kinds of bytes: white space, letters, signs, others.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, 9, 10, 11, 12, 13]] = 0
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[[ord(c) for c in SIGNS]] = 2
#: Words whose ids a worker keeps; the table is begun anew beyond that.
CACHED_WORDS = 1 << 20
CACHED_IDS = 1 << 23
#: Characters of the longest text of a batch that is also encoded as a whole, to check the parts.
CHECKED_CHARS = 20_000
#: Pairs that no tokenizer whose tokens end at white space may encode otherwise than one by one.
PROBES = ("word", "Word", "É", "e\u0301", "12", "x9", "'s", "...", "(", "—", "中文", "ﬁ", "İ", "<|", "\u00a0", "don't")


def pieces_at(data: bytes, cuts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start and end (exclusive), cut where a letter and a sign meet if asked."""
    a = np.frombuffer(data, np.uint8)
    if not cuts:
        return words_at(a)
    kind = np.concatenate(([0], KIND[a], [0])).astype(np.uint8)
    left, right = kind[:-1], kind[1:]
    edge = np.flatnonzero(((left == 0) != (right == 0)) | (left + right == 3))
    return edge[right[edge] != 0], edge[left[edge] != 0]


class Encoder:
    """Ids of whole texts, word by word where the tokenizer's tokens end at white space.

    Ids are kept by a 64-bit hash of a word's bytes: two of n different words share one with a chance of n**2 / 2**65.
    `whole` is set where probes show, or a text of a batch encoded both ways, that the tokenizer looks across white
    space; every text is then encoded as one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.levels = max(self.tokenizer.get_vocab().values(), default=0).bit_length()
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        plain = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        #: A special token that parts words encoded together.
        self.mark = next(((i, c) for i, c in plain if not any(x in c or c in x for x in self.marks if x != c)), None)
        #: Whether the case of A-Z never matters outside of special tokens.
        self.folds = all((self.encoded(chr(c)) == self.encoded(chr(c + 32))).all() and (self.encoded("x" + chr(c)) == self.encoded("x" + chr(c + 32))).all() for c in range(65, 91))
        self.whole = any(any(s.isspace() for s in m) for m in self.marks) or any(
            self.encoded(x + gap + y).tolist() != [*self.encoded(x), *self.encoded(y)] for x in PROBES for y in PROBES for gap in (" ", "\n", "\t\r", "\v\f ")
        )
        #: Whether tokens also end between a letter of A-Z and a sign.
        self.cuts = not any(len(pieces_at(m.encode(), True)[0]) > 1 for m in self.marks) and all(
            self.encoded(x + e * k + y).tolist() == [i for part in (x, e * k, y) for i in self.encoded(part)] for e in SIGNS for k in (1, 2) for x in ("word", "é", "") for y in ("s", "Next", "")
        )
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def encoded(self, text: str) -> np.ndarray:
        """The tokenizer's ids of one text."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's ids of several texts, and how many each has; those without special tokens with one call for all."""
        if self.mark and not any(m in w for m in self.marks for w in words):
            ids = self.encoded(self.mark[1].join(words))
            cut = np.flatnonzero(ids == self.mark[0])
            if len(cut) == len(words) - 1:
                return np.delete(ids, cut), np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
        got = [self.encoded(w) for w in words]
        return np.concatenate(got), np.array([len(x) for x in got], np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Keep the ids of words under their sorted hashes, which are new."""
        got, n = self.each(words)
        if len(self.keys) + len(keys) > CACHED_WORDS or self.used + len(got) > CACHED_IDS:
            raise OverflowError
        while self.used + len(got) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        at = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(got)] = got
        self.used += len(got)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = (np.insert(have, place, new) for have, new in ((self.keys, keys), (self.at, at), (self.n, n)))

    def folded(self, text: str | None) -> bytes:
        """A text's bytes, in lower case where that changes no id."""
        raw = (text or "").encode()
        return raw.translate(LOWER) if self.folds and not any(m[0] in text for m in self.marks if text) else raw

    def parts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, from those of its words."""
        raw = [self.folded(t) for t in texts]
        data = b" ".join(raw)
        a = np.frombuffer(data, np.uint8)
        start, end = pieces_at(data, self.cuts)
        keys, first, back = np.unique(hashes_at(a, start, end), return_index=True, return_inverse=True)
        for _ in range(2):
            slot = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(slot, len(self.keys) - 1)] != keys
            if not new.any():
                break
            try:
                self.learn(keys[new], [data[x:y].decode() for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            except OverflowError:
                self.clear()
        else:
            slot = np.searchsorted(self.keys, keys)
            if not len(self.keys) or (self.keys[np.minimum(slot, len(self.keys) - 1)] != keys).any():  # more words than are kept
                return [self.encoded(t or "") for t in texts]
        slot = np.searchsorted(self.keys, keys)[back]
        n, at = self.n[slot], self.at[slot]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cut = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw])[:-1])
        return np.split(ids, np.concatenate(([0], ends))[cut])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text."""
        for a, b in batches_of(texts):
            if self.whole:
                yield from (self.encoded(t or "") for t in texts[a:b])
                continue
            got = self.parts(texts[a:b])
            if a == 0 and len(texts[0] or "") <= CHECKED_CHARS and got[0].tolist() != self.encoded(texts[0] or "").tolist():
                self.whole = True
                got = [self.encoded(t or "") for t in texts[a:b]]
            yield from got


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, for this worker."""
    return Encoder(path)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    coder, part = encoder(path), TaskContext.get().partitionId()
    attempt = TaskContext.get().taskAttemptId()
    levels = max(coder.levels, end_id.bit_length(), 1)
    docs, arrays, held, made = [], [], 0, []

    def flush() -> None:
        nonlocal held
        name = f"{folder}/{part:06d}-{len(made):06d}-{attempt}.wvm"
        write_file(name, dump_shard(docs, np.array([len(a) for a in arrays], np.int64), np.concatenate(arrays), levels))
        made.append((part, len(made), name, len(docs), held))
        docs.clear(), arrays.clear()
        held = 0

    for ids, texts in rows_of(batches, "doc_id", "text"):
        for doc, got in zip(ids, coder.encode(texts), strict=True):
            docs.append(doc)
            arrays.append(np.append(got, np.uint32(end_id)))
            held += len(got) + 1
            if held >= shard_tokens:
                flush()
    if docs:
        flush()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["part", "seq", "path", "n_docs", "n_tokens"])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write token shards in ascending doc_id order (null first) and return their manifest.

    The manifest has a row per file: part, seq (its order), path, n_docs, n_tokens, start (ids in all files before).
    Null texts are empty and hold the end id alone; rows that share a doc_id stay rows of their own, in the order of
    their texts. Other columns are ignored; an empty table gives an empty manifest.
    """
    folder = shared_dir(docs.sparkSession, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = docs.mapInArrow(lambda it: _write(it, folder, tokenizer_path, end_id, shard_tokens), "part long, seq long, path string, n_docs long, n_tokens long")
    made = staged(made, "manifest")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for paths, starts in rows_of(batches, "path", "start"):
        for path, start in zip(paths, starts, strict=True):
            fs, at = filesystem(path)
            with fs.open_input_file(at) as f:
                docs, lengths, matrix = load_shard(f.read())
            ids = matrix.decode().astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e].data) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(tasks, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
