"""Retrievers: vectors by distance, texts by BM25. Each gives node_id and score, best first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Okapi BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); terms are lower-case runs of a-z and 0-9.
K1, B = 1.5, 0.75
#: Vectors of a block that is multiplied at once, and queries of a pass, which go to every task.
BLOCK, TOGETHER = 1024, 4096


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Cosine or L2 distance, or the negative inner product. A zero vector has no direction: its cosine distance is 1."""
    if metric == "cosine":
        return 1 - F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b))), F.lit(0.0))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda t, x: t + x))
    if metric == "ip":
        return -_dot(a, b)
    raise ValueError(metric)


def similarity(d: Column, metric: str) -> Column:
    """Of a distance: 1 - d for cosine, 1 / (1 + d) for L2, -d for the inner product."""
    return {"cosine": 1 - d, "l2": 1 / (1 + F.greatest(d, F.lit(0.0))), "ip": -d}[metric]


def vector_topk(vectors: DataFrame, query: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k vectors (node_id, embedding) most like the one of query (a row), ties by node_id; null vectors, and those of
    another length or with nulls, have no score and are left out. Nothing is shuffled but k rows a task."""
    q = query.limit(1).select(F.col("embedding").alias("q"))
    vectors = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    score = F.round(similarity(distance(F.col("embedding"), F.col("q"), metric), metric), 6)
    return vectors.join(F.broadcast(q)).where(F.size("embedding") == F.size("q")).select("node_id", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def best_each(scores: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, node_id, score) of each query_id, ties by node_id. Spark cuts each task's rows to k a query before the shuffle."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "node_id", "score")


class Best:
    """The k highest scores of each query, and what may tie with the last of them, gathered block by block."""

    def __init__(self, queries: int, k: int, slack: float = 1e-6, least: float = -np.inf):
        self.k, self.slack = k, slack
        self.least = np.full(queries, least)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """More scores of queries' rows."""
        self.found.append((query, score, row))
        self.held += len(query)
        if self.held > 4 * self.k * len(self.least) + 100_000:
            self.cut()

    def above(self, scores: np.ndarray, queries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the scores of a block, a row for each of some queries, that may be among the k best."""
        at = slice(None) if queries is None else queries
        over = lambda: scores >= (self.least[at] - self.slack).astype(scores.dtype)[:, None]
        high = over()
        if scores.shape[1] > self.k and np.count_nonzero(high) > self.k * len(scores):
            # the k best of a block are no better than the k best of all
            self.least[at] = np.maximum(self.least[at], np.partition(scores, -self.k, 1)[:, -self.k])
            high = over()
        return np.divmod(np.flatnonzero(high), scores.shape[1])

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and row of what is kept."""
        q, s, rows = (np.concatenate([f[i] for f in self.found]) if self.found else np.zeros(0, t) for i, t in enumerate((np.int64, float, np.int64)))
        order = np.lexsort((-s, q))
        start = np.searchsorted(q[order], np.arange(len(self.least) + 1))
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.least[full] = s[order][start[full] + self.k - 1]
        order = order[s[order] >= self.least[q[order]] - self.slack]
        self.found, self.held = [(q[order], s[order], rows[order])], len(order)
        return self.found[0]


def matrix(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as a matrix, and which rows they are: those of the given width, or that of the first, without nulls."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    long = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    width = width or int(long[long > 0][0]) if (long > 0).any() else width or 0
    rows = np.flatnonzero(long == width) if width else np.zeros(0, np.int64)
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width or 1)
    sound = ~np.isnan(x).any(1)
    return x[sound], rows[sound]


def likenesses(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """A row of scores for each query, by one product of matrices; cosine takes vectors of length one."""
    if metric != "l2":
        return q @ x.T
    return 1 / (1 + np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T), 0)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero vectors stay."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _nearest(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, metric: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    q, own = matrix(asked.column("embedding"))
    q, ids = unit(q) if metric == "cosine" else q, asked.column("query_id").combine_chunks().take(pa.array(own))
    best, kept, at = Best(len(q), k, 1e-5), [], 0
    for batch in batches if len(q) else ():
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            x, rows = matrix(part.column(1), q.shape[1])
            scores = likenesses(q, unit(x) if metric == "cosine" else x, metric)
            hit, where = best.above(scores)
            value = scores[hit, where]
            if metric == "l2" and len(hit):  # the product rounds small distances; what is kept is measured anew
                value = np.concatenate([1 / (1 + np.sqrt(((q[hit[i : i + BLOCK]] - x[where[i : i + BLOCK]]) ** 2).sum(1))) for i in range(0, len(hit), BLOCK)])
            best.add(hit, value, at + rows[where])
            kept.append(part.column(0))
            at += part.num_rows
            if len(kept) >= 64:  # only the ids of rows that are kept stay
                hit, value, row = best.cut()
                used, back = np.unique(row, return_inverse=True)
                kept = [pa.concat_arrays(kept).take(pa.array(used))]
                best.found, at = [(hit, value, back)], len(used)
    if kept:
        hit, value, row = best.cut()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), pa.concat_arrays(kept).take(pa.array(row)), pa.array(value)], names)


def in_passes(queries: DataFrame, together: int = TOGETHER) -> Iterator[pa.Table]:
    """Rows of queries (query_id, ...) as tables of some `together` rows each, dealt by a hash of query_id."""
    passes = max(1, -(-queries.count() // together))
    for at in range(passes):
        yield (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == at) if passes > 1 else queries).toArrow()


def vector_topk_each(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """As vector_topk for every row of queries (query_id, embedding): query_id, node_id, score.

    Queries go to all tasks, some TOGETHER in a pass; each task multiplies blocks of its vectors with all of them and
    keeps k a query. A query's vectors are compared with those of the length of the pass's first; null vectors give no rows.
    """
    names, kinds = ["query_id", "node_id", "score"], (dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["node_id"])
    schema = f"query_id {kinds[0]}, node_id {kinds[1]}, score double"
    rows = vectors.select("node_id", "embedding")
    parts = [rows.mapInArrow(lambda it, t=table: _nearest(it, t, k, metric, names), schema) for table in in_passes(queries.select("query_id", "embedding"))]
    return best_each(reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6)), k)


def tokens(c: Column) -> Column:
    """Terms of a text, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, terms: DataFrame | list[str] | None = None) -> DataFrame:
    """(term, node_id, size, tf) of documents (node_id, text): all terms, or those given as a list or rows (term).

    Terms are picked before anything is shuffled, if they are few; size is the number of terms of the whole text.
    """
    words = docs.select("node_id", tokens(F.col("text")).alias("words"))
    held = words.select("node_id", F.size("words").alias("size"), F.explode("words").alias("term"))
    if isinstance(terms, DataFrame):
        held = held.join(terms.select("term").distinct(), "term", "left_semi")
    elif terms is not None:
        held = held.where(F.col("term").isin(terms))
    return held.groupBy("term", "node_id", "size").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """One row (n, mean): documents and terms of one with a text."""
    words = tokens(F.col("text"))
    return docs.agg(F.count("*").alias("n"), F.avg(F.when(F.col("text").isNotNull(), F.size(words))).alias("mean"))


def gains(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, node_id, gain): what each posting adds to its document's BM25 score."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    gain = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return posted.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "node_id", gain.alias("gain"))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(node_id, score) of the documents (node_id, text) that hold a term."""
    return gains(postings(docs, terms), doc_stats(docs)).groupBy("node_id").agg(F.round(F.sum("gain"), 6).alias("score"))


def bm25_topk(docs: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """The k best by BM25, ties by node_id."""
    return bm25(docs, terms).orderBy(F.desc("score"), "node_id").limit(k)
