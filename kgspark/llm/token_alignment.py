"""Aligning the tokens of two tokenizers, from their spans and the bytes that their tokens stand for.

Text is cut into words wherever the two tokenizer files show that no token of either reaches across; a word's tokens
are the same wherever it stands, so each is aligned once. The spans that both tokenizers report give coarse cuts; where
a token holds part of a character or stands for a byte, the bytes of the decoded tokens refine them. How many documents
hold a pair of ids linked is counted by Spark over all documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import rows_of, staged
from kgspark.llm.shingles import batches_of

#: Words and links whose alignment a worker keeps; the table is begun anew beyond that.
CACHED_WORDS = 1 << 19
CACHED_LINKS = 1 << 22
#: Words that are encoded together.
TOGETHER = 1 << 14
#: Pairs of ids (16 bytes each) whose counts may be broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 3_000_000
SPACE = "▁"
#: A word starts at a space between a character that is no white space and any other.
WORDS = re.compile(r"(?<=\S) (?=[\s\S])")


def byte_of() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: bytes that print stand for themselves, the others for 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def parts_at_spaces(path_a: str, path_b: str) -> bool:
    """Whether both files show that no token reaches over the start of a word.

    The first must cut its text by the byte-level pattern before anything is merged, and leave the text as it is. The
    second must merge pieces without changing the text but for the space in front, and have no piece with a space after
    another character.
    """
    from sentencepiece import sentencepiece_model_pb2

    with open(path_a, encoding="utf-8") as f:
        a = json.load(f)
    cut = a.get("pre_tokenizer") or {}
    model = sentencepiece_model_pb2.ModelProto()
    with open(path_b, "rb") as f:
        model.ParseFromString(f.read())
    rule, merges = model.normalizer_spec, model.trainer_spec.model_type == 2
    plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
    inner = any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces) or any(p.type == 4 for p in model.pieces)
    return a.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and merges and plain and not inner


def either(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct numbers of two sorted arrays, in order."""
    z = np.sort(np.concatenate((x, y)), kind="stable")
    return z[np.append(True, z[1:] != z[:-1])] if len(z) else z


class Aligner:
    """Tokens of texts by both tokenizers, with the groups between common ends and the links between overlapping tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        signs, special = byte_of(), {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = special[i].encode() if i in special else bytes(signs[c] for c in t)
        n = self.size_b = self.b.get_piece_size()
        self.is_byte = np.array([self.b.is_byte(i) for i in range(n)])
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE, " ").encode() for p, byte in zip(map(self.b.id_to_piece, range(n)), self.is_byte, strict=True)]
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{sign}" for i in range(max(len(self.bytes_a), n)) for sign in ",|;"]
        self.parts = parts_at_spaces(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.known: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)  # tokens of each, groups, whether the bytes are the text's
        self.groups: list[str] = []
        self.met = np.zeros(0, np.int64)  # in how many blocks of texts
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)  # of all words one after another, and where each word's end

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the space in front of it."""
        return WORDS.split(text) if self.parts else [text]

    def cuts(self, want: bytes, spans: np.ndarray, ends_b: np.ndarray, ids_b: np.ndarray, true_a: np.ndarray, true_b: np.ndarray) -> np.ndarray:
        """The bytes at which tokens of both end.

        spans are the first tokenizer's, in characters; ends_b the second's, in bytes. Where a token starts before the
        one in front of it has ended it holds part of a character; there, and beside tokens that stand for a byte,
        true_a and true_b, the ends of the decoded tokens, are used.
        """
        first = np.flatnonzero((np.frombuffer(want, np.uint8) & 0xC0) != 0x80)
        at = np.append(first, len(want))
        whole = np.append(spans[1:, 0] >= spans[:-1, 1], True)
        byte = self.is_byte[ids_b]
        plain = ~byte & ~np.append(byte[1:], False)
        coarse = np.intersect1d(at[spans[whole, 1]], ends_b[plain] + 1, assume_unique=True)
        rough = np.concatenate((true_a[~whole], true_b[~plain]))  # a segment with such an end is looked at byte by byte
        if not len(rough):
            return coarse
        rough = np.unique(np.searchsorted(coarse, rough))
        inside = [t[np.isin(np.searchsorted(coarse, t), rough)] for t in (true_a, true_b)]
        return either(coarse, np.intersect1d(*inside, assume_unique=True))

    def align(self, words: list[str]) -> None:
        """Keep the alignment of words that follow each other as a text; where the bytes are not the text's, of halves of it."""
        text = " ".join(words)
        want, a, pieces = b" " + text.encode(), self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text, return_type="proto").pieces
        both = [x for p in pieces for x in (p.id, p.end)]
        list_a, list_b = a.ids, both[::2]
        ids_a, ids_b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        if b"".join(map(self.bytes_a.__getitem__, list_a)) != want or b"".join(map(self.bytes_b.__getitem__, list_b)) != want:
            if len(words) > 1:
                self.align(words[: len(words) // 2])
                self.align(words[len(words) // 2 :])
            else:
                self.keep(words, np.array([[len(ids_a), len(ids_b), 0, 0]]), [""], np.zeros(0, np.int64), np.zeros(1, np.int64))
            return
        end_a, end_b = np.cumsum(self.long_a[ids_a]), np.cumsum(self.long_b[ids_b])
        cut = self.cuts(want, np.array(list(chain.from_iterable(a.offsets)), np.int64).reshape(-1, 2), np.array(both[1::2], np.int64), ids_b, end_a, end_b)
        # between neighbouring ends of either lies one link, and each link has one such place
        ends = either(end_a, end_b)
        links = ids_a[np.searchsorted(end_a, ends)] * self.size_b + ids_b[np.searchsorted(end_b, ends)]
        word = np.cumsum([len(w.encode()) + 1 for w in words])
        upto = [np.searchsorted(x, word, "right") for x in (end_a, end_b, cut, ends)]
        counts = [np.diff(np.concatenate(([0], u))) for u in upto[:3]]
        # tokens by group, the first tokenizer's in front, each with the sign after it
        group = np.concatenate((2 * np.searchsorted(cut, end_a), 2 * np.searchsorted(cut, end_b) + 1))
        order = np.argsort(group, kind="stable")
        step = np.append(group[order][1:], -1) - group[order]
        sign = np.where(step == 0, 0, np.where(group[order] % 2 == 0, 1, 2))
        shown = list(map(self.shown.__getitem__, (np.concatenate((ids_a, ids_b))[order] * 3 + sign).tolist()))
        till = (upto[0] + upto[1]).tolist()
        strings = ["".join(shown[x:y])[:-1] for x, y in zip([0, *till], till)]  # noqa: B905
        self.keep(words, np.stack([*counts, np.ones(len(words), np.int64)], 1), strings, links, upto[3])

    def keep(self, words: list[str], counts: np.ndarray, groups: list[str], links: np.ndarray, ends: np.ndarray) -> None:
        """Put words' alignments behind those that are kept."""
        self.known |= zip(words, range(len(self.groups), len(self.groups) + len(words)), strict=True)
        self.counts, self.groups = np.concatenate((self.counts, counts)), self.groups + groups
        self.links, self.ends = np.concatenate((self.links, links)), np.concatenate((self.ends, self.ends[-1] + ends))

    def trim(self) -> None:
        """Forget the words met in one block of texts alone, and all if that leaves too many."""
        words, kept = list(self.known), np.flatnonzero(self.met > 1)
        some = self.ends[kept + 1] - self.ends[kept]
        if len(kept) > CACHED_WORDS // 2 or some.sum() > CACHED_LINKS // 2:
            self.clear()
            return
        ends = np.append(0, np.cumsum(some))
        self.links = self.links[np.repeat(self.ends[kept] - ends[:-1], some) + np.arange(ends[-1])]
        self.counts, self.ends, self.met = self.counts[kept], ends, np.zeros(len(kept), np.int64)
        self.groups = [self.groups[k] for k in kept.tolist()]
        self.known = {words[k]: i for i, k in enumerate(kept.tolist())}

    def slots(self, words: list[str]) -> np.ndarray:
        """Where each word's alignment is kept."""
        if len(self.known) > CACHED_WORDS or len(self.links) > CACHED_LINKS:
            self.trim()
        new = set(words) - self.known.keys()
        alone = [w for w in new if not w or w[-1].isspace()]
        some = [w for w in new if w and not w[-1].isspace()] if self.parts else []
        for at in range(0, len(some), TOGETHER):
            self.align(some[at : at + TOGETHER])
        for w in alone if self.parts else new:
            self.align([w])
        slot = np.array(list(map(self.known.__getitem__, words)), np.int64)
        self.met = np.append(self.met, np.zeros(len(self.groups) - len(self.met), np.int64))
        self.met[np.unique(slot)] += 1
        return slot

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Of each text: (tokens of each, groups, links); the groups as text; the linked ids and how often each is linked."""
        words = [self.words(t) if t else [] for t in texts]
        slot = self.slots([w for ws in words for w in ws])
        upto = np.cumsum([0, *map(len, words)])
        total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.counts[slot], 0)))
        counts = total[upto[1:]] - total[upto[:-1]]
        sound = (counts[:, 3] == np.diff(upto)) & (counts[:, 3] > 0)
        some = self.ends[slot + 1] - self.ends[slot]
        start = np.cumsum(some) - some
        links = self.links[np.repeat(self.ends[slot] - start, some) + np.arange(int(some.sum()))]
        after = np.append(start, len(links))[upto]
        counts[:, 3] = np.diff(after)
        counts[~sound] = 0
        spread = [np.unique(links[x:y] if good else links[:0], return_counts=True) for x, y, good in zip(after[:-1].tolist(), after[1:].tolist(), sound.tolist(), strict=True)]
        held, at = list(map(self.groups.__getitem__, slot.tolist())), upto.tolist()
        return counts, [";".join(held[x:y]) if good else "" for x, y, good in zip(at[:-1], at[1:], sound.tolist(), strict=True)], spread


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two tokenizer files, for this worker."""
    return Aligner(path_a, path_b)


def _align(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, groups: bool) -> Iterator[pa.RecordBatch]:
    both, part, n = aligner(path_a, path_b), TaskContext.get().partitionId() << 33, 0
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    for ids, texts in rows_of(batches, "doc_id", "text"):
        for x, y in batches_of(texts):
            numbers, strings, pairs = both.documents(texts[x:y])
            marks = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in strings]
            offsets = np.cumsum([0, *[len(p) for p, _ in pairs]]).astype(np.int32)
            kinds = [np.concatenate([p[k] for p in pairs]) for k in (0, 1)]
            linked = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(kinds[0], pa.int64()), pa.array(kinds[1].astype(np.int32))], ["pair", "times"]))
            rows = pa.array(range(part + n, part + n + y - x), pa.int64())
            n += y - x
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(ids[x:y], pa.int64()), *[pa.array(numbers[:, k]) for k in range(4)], pa.array(marks), linked, *([pa.array(strings)] if groups else [])],
                [*names, *(["groups"] if groups else [])],
            )


def alignments(docs: DataFrame, path_a: str, path_b: str, groups: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links[, groups].

    path_a is a byte-level file of the tokenizers library, which gets the text with a space in front; path_b a
    sentencepiece model that puts that space there itself. Both take special tokens' strings as plain text. groups
    lists the ids between common ends as 'a1,a2|b1;a3|b2,b3', links has (pair, times) for each pair of linked ids of the
    document, pair being a * (size of B's vocabulary) + b; row numbers the rows. Texts that are null or empty, or whose
    tokens do not give their bytes back, have no tokens: zeros, empty strings and no links.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: int>>"
    return rows.mapInArrow(lambda it: _align(it, path_a, path_b, groups), schema + (", groups string" if groups else ""))


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best) over rows of alignments: how many rows hold the pair, and whether no pair of its A id has more."""
    counts = rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = staged(counts.select("pair", F.expr(f"pair div {size_b}").cast("int").alias("a"), "docs"), "pair_counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def link_strengths(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link counts as often as documents hold its pair of ids linked: count_sum adds that up over a row's links, n_best
    counts the links whose pair no other pair of its A id exceeds. Rows without tokens have zeros and an empty
    groups_sha256; repeated rows, also of one doc_id, are documents of their own; a null doc_id stays null. Other
    columns are ignored; an empty table gives an empty result.
    """
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = staged(alignments(docs, path_a, path_b, groups=False), "aligned")
    # a pair that one document alone holds is left out unless it is its A id's best
    counts = pair_counts(rows, size_b).where("docs > 1 or best")
    counts = staged(counts, "pairs")
    if counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = rows.select("row", F.explode("links").alias("x")).select("row", "x.pair", "x.times").join(counts, "pair", "left")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.coalesce("docs", F.lit(1))).alias("count_sum"))
    x = rows.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
