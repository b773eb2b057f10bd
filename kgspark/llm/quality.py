"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded as the mean of learned vectors of its hashed
words and word shapes and of how much of it repeats elsewhere in its document. Gated attention weighs the passages, and
the weighted mean is scored; only documents carry labels. Training runs on a bounded sample; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import rows_of
from kgspark.llm.shingles import batches_of, mixed, sequence_hashes, words_of

PASSAGE = 64
WORDS, SHAPES, REPEATS = 1 << 13, 1 << 12, 6
WIDTH, GATE = 16, 8
#: The bound of the training sample: labelled rows, characters of each and of all. Longer documents are scored, not learned from.
TRAIN_ROWS = 6000
TRAIN_CHARS = 100_000
#: Characters of the whole sample, which the driver holds.
TRAIN_TOTAL = 40_000_000
EPOCHS = 8
BATCH = 48
#: Passages that are encoded at a time.
ENCODED = 4096
RATE = 0.01
SEED = 7


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: feature ids of all words (two columns), where each passage starts, its repeat feature, its text.

    A text without words has one passage without words, whose start is the next passage's.
    """
    words, shapes, of = words_of(texts)
    same = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) + 1
    shapes[same] = mixed(shapes[same])  # a word that stands twice in a row
    ids = np.stack((words % np.uint64(WORDS), shapes % np.uint64(SHAPES) + np.uint64(WORDS)), 1).astype(np.int32)
    count = np.bincount(of, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    n = np.maximum(1, -(-count // PASSAGE))
    text = np.repeat(np.arange(len(texts)), n)
    start = first[text] + PASSAGE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    runs = sequence_hashes(words) if len(words) >= 5 else np.zeros(0, np.uint64)
    again = np.zeros(len(words), np.float32)
    if len(runs):
        inside = of[: len(runs)] == of[4:]
        key = mixed(runs + of[: len(runs)].astype(np.uint64))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        again[: len(runs)] = (times[back] > 1) & inside
    size = np.diff(np.append(start, len(words)))
    share = np.add.reduceat(np.append(again, 0), start) / np.maximum(size, 1) if len(start) else np.zeros(0)
    repeat = np.where(size == 0, 5, np.minimum(4, np.ceil(np.where(size == 0, 0, share) * 4))).astype(np.int32)
    return ids, start, repeat + WORDS + SHAPES, text


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; a run that is empty sums to 0."""
    if not len(values):
        return np.zeros((len(start), *values.shape[1:]), values.dtype)
    out = np.add.reduceat(values, np.minimum(start, len(values) - 1))
    out[np.diff(np.append(start, len(values))) == 0] = 0
    return out


def fresh(seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters before training."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {"E": draw(WORDS + SHAPES + REPEATS, WIDTH, scale=0.1), "V": draw(WIDTH, GATE, scale=0.3), "U": draw(WIDTH, GATE, scale=0.3), "w": draw(GATE, scale=0.3), "c": draw(WIDTH, scale=0.3), "b": np.zeros(1, np.float32)}


def forward(p: dict[str, np.ndarray], ids: np.ndarray, start: np.ndarray, repeat: np.ndarray, text: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Scores of n texts from their passages, with what the way back needs."""
    size = np.diff(np.append(start, len(ids)))
    table = p["E"]
    raw = np.empty((len(start), WIDTH), np.float32)
    for k in range(0, len(start), ENCODED):  # the words' vectors of all passages at once would be many times the text
        own = slice(k, k + ENCODED)
        low, high = start[k], start[k + ENCODED] if k + ENCODED < len(start) else len(ids)
        raw[own] = _sums(table[ids[low:high, 0]] + table[ids[low:high, 1]], start[own] - low)
    raw = raw / np.maximum(size, 1)[:, None].astype(np.float32) + table[repeat]
    h = np.tanh(raw)
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    bag = np.searchsorted(text, np.arange(n))
    a = np.exp(e - np.maximum.reduceat(e, bag)[text])
    a /= np.add.reduceat(a, bag)[text]
    z = np.add.reduceat(a[:, None] * h, bag)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
    return {"size": size, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "bag": bag}


def backward(p: dict[str, np.ndarray], f: dict, ids: np.ndarray, repeat: np.ndarray, text: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted mean log loss."""
    d = ((f["y"] - labels) * weights / weights.sum()).astype(np.float32)
    dz = d[:, None] * p["c"]
    da = (dz[text] * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["bag"])[text])
    dts = de[:, None] * p["w"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz[text] + dt @ p["V"].T + ds @ p["U"].T
    raw = dh * (1 - f["h"] ** 2)
    each = np.repeat(raw / np.maximum(f["size"], 1)[:, None], f["size"], 0)
    flat = np.concatenate((ids[:, 0], ids[:, 1], repeat)).astype(np.int64)
    grads = np.concatenate((each, each, raw))
    table = np.stack([np.bincount(flat, grads[:, k], len(p["E"])) for k in range(WIDTH)], 1)
    return {"E": table.astype(np.float32), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "b": np.array([d.sum()], np.float32)}


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Learn from labelled texts with Adam; both labels weigh the same in all. One label alone gives its share as score."""
    y = np.asarray(labels, np.float32)
    p, rng = fresh(seed), np.random.default_rng(seed)
    if not len(y) or not 0 < y.mean() < 1:
        p["c"][:] = 0
        p["b"][:] = 5 if len(y) and y[0] else -5 if len(y) else 5
        return p
    weigh = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    bags = []
    for at in range(0, len(texts), BATCH):
        bags.append((passages(texts[at : at + BATCH]), slice(at, min(len(texts), at + BATCH))))
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            (ids, start, repeat, text), part = bags[k]
            f = forward(p, ids, start, repeat, text, part.stop - part.start)
            step += 1
            for name, g in backward(p, f, ids, repeat, text, y[part], weigh[part]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                p[name] -= (RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def scores(p: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """From 0 to 1, higher where label 1 is likelier."""
    out = [np.zeros(0)]
    for a, b in batches_of(texts):
        ids, start, repeat, text = passages(texts[a:b])
        out.append(forward(p, ids, start, repeat, text, b - a)["y"].astype(float))
    return np.concatenate(out)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, total: int = TRAIN_TOTAL) -> dict[str, np.ndarray]:
    """Fit on at most `rows` labelled documents of at most `chars` characters, and `total` in all, chosen by a hash of doc_id."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    sample = docs.where(F.char_length(F.coalesce("text", F.lit(""))) <= chars).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "text").limit(rows)
    so_far = F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(W.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "text").rowsBetween(W.unboundedPreceding, 0))
    sample = sample.withColumn("so_far", so_far).where(F.col("so_far") <= total).toPandas()
    return fit(sample["text"].tolist(), sample["quality"].tolist())


def _score(batches: Iterator[pa.RecordBatch], p: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = scores(p, batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Null texts are scored as empty ones. A row without doc_id counts as not held out and is never learned from. With
    no labels at all every document gets one high score. Other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(lambda it: _score(it, model.value), "doc_id long, held_out boolean, score double, predicted int")


def _good(batches: Iterator[pa.RecordBatch], p: dict[str, np.ndarray], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(scores(p, batch.column(column).to_pylist()) >= 0.5))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier predicts to be of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    column = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _good(it, model.value, column), docs.schema)
