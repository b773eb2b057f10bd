"""Exact repeats of LIMIT bytes across all documents, found by sorting suffixes.

Of the LIMIT - GRAM + 1 grams of GRAM bytes in a window of LIMIT bytes, the one with the smallest hash (the first of
equal ones) is the window's anchor, so equal windows have equal anchors at equal places. Anchors whose gram occurs once
in the corpus are dropped. The others' contexts, the bytes of all windows that they anchor, are dealt by gram and
sorted, so that no two equal windows ever meet in different tasks.

Within a gram, the suffixes that start at the anchor and the reversed prefixes that end there are sorted deep-shallow:
multikey quicksort, eight bytes a key, orders them to a shallow depth, and a blind trie orders each group that is still
equal there. From the common prefixes of neighbours follows which windows are equal: those whose two parts are.
Contexts of one gram beyond GROUP distinct ones, as where a passage of a third of all documents ends, are handed on
window by window and dealt anew by the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import BROADCAST_IDS, narrowed, rows_of, staged
from kgspark.llm.shingles import BLOCK, mixed, powers

LIMIT = 100
GRAM = 24
SHALLOW = 24
GROUP = 200_000
#: Contexts that a task sorts together, if a gram has not more.
CHUNK = 60_000
SEGMENT = BLOCK


def anchors(text: bytes, limit: int = LIMIT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its gram's hash, its place, how far before it its first window starts, its windows less one."""
    parts = [_anchors(text[at : at + SEGMENT + limit - 1], at, limit, gram) for at in range(0, max(1, len(text) - limit + 1), SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _anchors(text: bytes, base: int, limit: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(text) - limit + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.frombuffer(text, np.uint8)
    up, down = powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    g = mixed((total[gram:] - total[:-gram]) * down[: len(a) - gram + 1])
    low, have, want = g, 1, limit - gram + 1
    while 2 * have <= want:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < want:
        low = np.minimum(low[: n], low[want - have : want - have + n])
    # the first gram of a window that has its smallest hash: try the grams that are the smallest of any window
    top = np.concatenate((np.zeros(want - 1, np.uint64), low, np.zeros(want - 1, np.uint64)))
    have = 1
    while 2 * have <= want:
        top = np.maximum(top[:-have], top[have:])
        have *= 2
    if have < want:
        top = np.maximum(top[: len(g)], top[want - have : want - have + len(g)])
    chosen = top[: len(g)] == g
    place = np.flatnonzero(chosen)
    k = np.cumsum(chosen)[:n] - chosen[:n]
    off = np.flatnonzero(g[place[k]] != low)
    while len(off):
        k[off] += 1
        off = off[g[place[k[off]]] != low[off]]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    at = place[k[first]]
    count = np.diff(np.append(first, n))
    return g[at].view(np.int64), at + base, at - first, count - 1


def _lcp(a: bytes, b: bytes, start: int = 0) -> int:
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n]) ^ int.from_bytes(b[start:n])
    return start + (n - start) - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The sorted order of strings, and of each but the first in it the common prefix with the one before.

    Inner nodes keep a depth and a child for each byte there (-1 past the end), leaves the indexes of equal strings. A
    string goes down by those bytes alone to some leaf, is compared with it once, and branches off where they differ.
    """
    root: list = [None, [0]]  # a leaf; an inner node is [depth, {byte: node}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] is not None:
            d = node[0]
            node = node[1].get(s[d] if d < len(s) else -1) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        depth = _lcp(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            continue
        node = root
        while node[0] is not None and node[0] < depth:
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        leaf = [None, [i]]
        mine = s[depth] if depth < len(s) else -1
        if node[0] == depth:
            node[1][mine] = leaf
        else:
            old = [node[0], node[1]]
            node[0], node[1] = depth, {(other[depth] if depth < len(other) else -1): old, mine: leaf}
    order: list[int] = []
    lcp: list[int] = []
    todo = [(root, 0)]
    while todo:
        node, before = todo.pop()
        if node[0] is None:
            lcp += [before] + [len(strings[node[1][0]])] * (len(node[1]) - 1)
            order += node[1]
        else:
            kids = sorted(node[1].items())
            todo += [(kid, before if k == 0 else node[0]) for k, (_, kid) in reversed(list(enumerate(kids)))]
    return order, lcp[1:]


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings within ascending groups: the order, and the common prefix with the string before (-1: none, another group)."""
    head = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(len(strings), -1).astype(np.uint64)
    order = _multikey([group.astype(np.uint64), *head.T])
    same = np.ones(len(order), bool)
    lcp = np.zeros(len(order), np.int64)
    size = np.array([len(s) for s in strings], np.int64)
    for w in head.T:
        x = w[order[1:]] ^ w[order[:-1]]
        lead = np.where(x == 0, 8, (64 - 1 - np.floor(np.log2(np.maximum(x, 1).astype(np.longdouble))).astype(np.int64)) // 8)
        lcp[1:] += np.where(same[1:], lead, 0)
        same[1:] &= x == 0
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    fresh = np.concatenate(([True], group[order[1:]] != group[order[:-1]]))
    lcp[fresh] = -1
    same[fresh] = False
    start = np.flatnonzero(~same)
    for a, b in zip(start.tolist(), np.append(start[1:], len(order)).tolist(), strict=True):
        if b - a > 1:
            own = order[a:b]
            inner, deep = blind_trie([strings[i] for i in own])
            order[a:b] = own[inner]
            lcp[a + 1 : b] = deep
    return order, lcp


def _multikey(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, runs of equal ones by the second, and so on; only runs that are still equal go on."""
    order = np.argsort(keys[0], kind="stable")
    equal = np.concatenate(([False], keys[0][order[1:]] == keys[0][order[:-1]]))
    for key in keys[1:]:
        member = equal | np.append(equal[1:], False)
        at = np.flatnonzero(member)
        if not len(at):
            break
        run = np.cumsum(~equal[at])
        own = order[at]
        own = own[np.lexsort((key[own], run))]
        order[at] = own
        equal[at] = equal[at] & (key[own] == np.concatenate((key[own[:1]], key[own[:-1]])))
    return order


def repeated_windows(contexts: list[bytes], off: np.ndarray, group: np.ndarray, rank: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of those windows that equal one of the same group whose context has a lower rank.

    off is where the anchor stands in a context; window i is the limit bytes from i on.
    """
    n = len(contexts)
    size = np.array([len(c) for c in contexts], np.int64)
    classes = []
    for strings in ([c[o:] for c, o in zip(contexts, off.tolist(), strict=True)], [c[:o][::-1] for c, o in zip(contexts, off.tolist(), strict=True)]):
        order, lcp = deep_shallow(strings, group)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        classes.append((lcp, back))
    by_rank = np.argsort(rank, kind="stable")
    found = []
    for o in range(int(off.max(initial=0)) + 1):
        has = by_rank[(off[by_rank] >= o) & (off[by_rank] - o <= size[by_rank] - limit)]
        if len(has) < 2:
            continue
        (right, at), (left, to) = classes
        code = np.cumsum(right < limit - o)[at[has]] * (n + 1) + np.cumsum(left < o)[to[has]]
        first = np.unique(code, return_index=True)[1]
        again = np.ones(len(has), bool)
        again[first] = False
        again = has[again]
        found.append((again, off[again] - o))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_of(batches, "doc_id", "text"):
        out: list[tuple[np.ndarray, ...]] = []
        for doc, text in zip(ids, texts, strict=True):
            key, at, before, more = anchors((text or "").encode())
            out.append((key, np.full(len(key), doc, np.int64), at << 16 | before << 8 | more))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["gram", "doc_id", "place"])


CONTEXT = "gram long, context binary, off int, doc_id long, start long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, grams, places in rows_of(batches, "doc_id", "text", "grams", "places"):
        rows: list[tuple] = []
        for doc, text, gs, ps in zip(ids, texts, grams, places, strict=True):
            raw = (text or "").encode()
            for g, p in zip(gs, ps, strict=True):
                at, before, more = p >> 16, p >> 8 & 255, p & 255
                rows.append((g, raw[at - before : at - before + more + LIMIT], before, doc, at - before))
            if len(rows) > 50_000:
                yield _context_batch(rows)
                rows = []
        if rows:
            yield _context_batch(rows)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["gram", "context", "off", "doc_id", "start"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, context, doc_id, start to runs of removed bytes; windows of grams beyond GROUP are handed on."""
    held: list[tuple] = []  # distinct contexts with their first place: gram, context, off, doc_id, start
    out: list[tuple] = []
    gram = last = None
    begin, over = 0, False  # where the current gram's contexts begin in held; whether they are handed on

    def hand_on(rows: list[tuple]) -> None:
        for _, c, _, doc, start in rows:
            out.extend((doc, start + i, start + i + LIMIT, c[i : i + LIMIT]) for i in range(len(c) - LIMIT + 1))

    def solve(rows: list[tuple]) -> None:
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        some = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(some):
            rows = [rows[i] for i in some.tolist()]
            off = np.array([r[2] for r in rows], np.int64)
            doc, start = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
            rank = np.empty(len(rows), np.int64)
            rank[np.lexsort((start + off, doc))] = np.arange(len(rows))
            which, window = repeated_windows([r[1] for r in rows], off, group[some], rank)
            order = np.lexsort((window, which))
            which, window = which[order], window[order]
            fresh = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)))) if len(which) else which
            end = np.append(fresh[1:], len(which)) - 1 if len(which) else which
            out.extend((int(doc[w]), int(start[w] + a), int(start[w] + b + LIMIT), None) for w, a, b in zip(which[fresh], window[fresh], window[end], strict=True))

    for cols in rows_of(batches, "gram", "context", "off", "doc_id", "start"):
        for row in zip(*cols, strict=True):
            if row[0] != gram:
                if len(held) >= CHUNK:
                    solve(held)
                    held = []
                gram, last, begin, over = row[0], None, len(held), False
            if row[1] == last:
                out.append((row[3], row[4], row[4] + len(last), None))
                continue
            last = row[1]
            if over:
                hand_on([row])
            else:
                held.append(row)
                if len(held) - begin > GROUP:
                    hand_on(held[begin:])
                    del held[begin:]
                    over = True
            if len(out) > 50_000:
                yield _span_batch(out)
                out.clear()
        if len(out) > 50_000:
            yield _span_batch(out)
            out.clear()
    if held:
        solve(held)
    if out:
        yield _span_batch(out)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "window"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, starts, ends in rows_of(batches, "doc_id", "text", "starts", "ends"):
        rows = []
        for doc, text, a, b in zip(ids, texts, starts, ends, strict=True):
            raw, kept, spans, at, removed = (text or "").encode(), hashlib.sha256(), 0, 0, 0
            for x, y in sorted(zip(a, b, strict=True)):
                y = min(y, len(raw))
                if x > at or not spans:
                    kept.update(raw[at:x])
                    spans += 1
                    removed += max(0, y - x)
                    at = y
                elif y > at:
                    removed += y - at
                    at = y
            kept.update(raw[at:])
            rows.append((doc, len(raw), removed, spans, kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end) of runs of bytes covered by repeats of LIMIT bytes; runs may overlap. doc_id must not be null."""
    found = docs.mapInArrow(_find, "gram long, doc_id long, place long")
    by = W.partitionBy("gram").orderBy("doc_id", "place")
    found = found.withColumn("before", F.lag("place").over(by)).withColumn("after", F.lead("place").over(by)).where("before is not null or after is not null")
    asked = staged(found.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"), F.collect_list("place").alias("places")), "anchors")
    rows = narrowed(docs, asked.select("doc_id"), "doc_id").join(asked, "doc_id").select("doc_id", "text", "grams", "places").mapInArrow(_contexts, CONTEXT)
    rows = rows.repartition("gram").sortWithinPartitions("gram", "context", "doc_id", "start")
    spans = staged(rows.mapInArrow(_repeats, "doc_id long, start long, end long, window binary"), "spans")
    rest = spans.where("window is not null").withColumn("n", F.row_number().over(W.partitionBy("window").orderBy("doc_id", "start"))).where("n > 1")
    return spans.where("window is null").select("doc_id", "start", "end").unionByName(rest.select("doc_id", "start", "end"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LIMIT bytes that covers it also starts earlier, in a smaller doc_id or before in the same
    text. Texts count as UTF-8, null as empty. Rows that share a doc_id are one document: each has the runs of all of
    them removed and none makes the others repeats. Rows without doc_id keep all bytes and make nothing a repeat. Other
    columns are ignored; an empty table gives an empty result. Whole copies of an earlier text are removed as such
    before the search.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = staged(docs.select("doc_id", F.sha2("text", 256).alias("mark"), F.octet_length("text").cast("long").alias("n_bytes")), "marks")
    first = marks.where("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("first"))
    marks = marks.join(first, "mark", "left")
    copies = F.col("doc_id") > F.col("first")
    whole = staged(marks.where(copies & (F.col("n_bytes") >= LIMIT)).select("doc_id", "n_bytes").distinct(), "copies")
    few = whole.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rest = docs.where("doc_id is not null").join(F.broadcast(whole) if few else whole, "doc_id", "left_anti")
    spans = staged(repeats(rest).distinct().groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    cut = narrowed(docs, spans.select("doc_id"), "doc_id").join(spans, "doc_id").select("doc_id", "text", "starts", "ends")
    cut = cut.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    touched = spans.select("doc_id").unionByName(whole.select("doc_id")).distinct()
    few = touched.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = marks.join(F.broadcast(touched) if few else touched, "doc_id", "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("mark").alias("kept_sha256"))
    gone = marks.select("doc_id").join(whole, "doc_id").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))
    return cut.unionByName(same).unionByName(gone)
