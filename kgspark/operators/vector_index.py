"""An index of vectors by cells: those nearest to the same center are stored together, and a query looks at some cells only.

Centers are fitted on a sample of SAMPLE rows; every row is put into a cell. How many cells a query looks at is the least
number that held TARGET of the sample's own nearest neighbours, measured when the index is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.retrieval import BLOCK, Best, best_each, likenesses, matrix, unit
from kgspark.sources.shared import shared_dir

#: Rows that the centers are fitted on, at most some so many, and rows of these that the number of probes is fitted with.
SAMPLE, TRIED = 20_000, 200
#: Rounds of fitting; the cells are the square root of the number of rows, one for FEWEST sampled rows at most.
ROUNDS, FEWEST = 8, 8
#: The share of a sampled row's NEAREST neighbours that its probes must hold on average.
TARGET, NEAREST = 0.97, 10
#: Queries of a pass: all cells are read once for so many. What products of single precision may be wrong by, twice, and more.
TOGETHER, NEAR = 1 << 14, 3e-5


def _placed(x: np.ndarray, metric: str, longest: float) -> np.ndarray:
    """Vectors whose Euclidean distances order them as the metric does: of length one for cosine; for the inner product
    with one more coordinate that brings all to the greatest length."""
    if metric == "cosine":
        return unit(x)
    if metric == "ip":
        return np.column_stack((x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))))
    return x


def _asked(q: np.ndarray, metric: str) -> np.ndarray:
    return np.column_stack((q, np.zeros(len(q)))) if metric == "ip" else _placed(q, metric, 0)


def _by_distance(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances but for a term of each row's own."""
    return (centers * centers).sum(1) - 2 * (x @ centers.T)


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centers by Lloyd's rounds from evenly drawn rows; one that no row is nearest to stays where it is."""
    centers = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([_by_distance(x[i : i + BLOCK], centers).argmin(1) for i in range(0, len(x), BLOCK)])
        n = np.bincount(own, minlength=cells)
        for c in np.flatnonzero(n):
            centers[c] = x[own == c].mean(0)
    return centers


def probes_for(x: np.ndarray, centers: np.ndarray, metric: str) -> int:
    """How many of the nearest cells hold TARGET of the nearest neighbours of sampled rows, each different row counting once."""
    own = np.concatenate([_by_distance(x[i : i + BLOCK], centers).argmin(1) for i in range(0, len(x), BLOCK)])
    q = np.unique(x, axis=0)
    q = q[np.random.default_rng(0).permutation(len(q))[:TRIED]]
    if metric == "ip":
        q[:, -1] = 0
    near = np.argpartition(_by_distance(q, x), min(NEAREST, len(x) - 1), 1)[:, : NEAREST + 1]
    rank = np.argsort(np.argsort(_by_distance(q, centers), 1), 1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def _celled(batches: Iterator[pa.RecordBatch], centers: np.ndarray, metric: str, longest: float, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x, rows = matrix(part.column(1), width)
            cell = _by_distance(_placed(x, metric, longest), centers).argmin(1).astype(np.int32)
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0).take(rows), part.column(1).take(rows)], ["cell", "node_id", "embedding"])


def asking(probed: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The queries that look at each cell, cell after cell, and where each cell's begin; a row of probed has a query's cells."""
    order = np.argsort(probed.ravel(), kind="stable")
    return (order // probed.shape[1]).astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(probed.ravel(), minlength=cells))))


def _searched(batches: Iterator[pa.RecordBatch], ids: pa.Array, q: np.ndarray, probed: np.ndarray, cells: int, k: int, metric: str, least: float) -> Iterator[pa.RecordBatch]:
    best, kept, at = Best(len(q), k, NEAR, least), [], 0
    who, begin = asking(probed, cells)
    q = unit(q) if metric == "cosine" else q
    # products of unit vectors in single precision leave most out; what may be among the best is multiplied again
    rough = q.astype(np.float32) if metric == "cosine" else q
    for batch in batches:
        own = batch.column(2).to_numpy()
        x, rows = matrix(batch.column(1), q.shape[1])
        x, own = unit(x) if metric == "cosine" else x, own[rows]
        fast = x.astype(np.float32) if metric == "cosine" else x
        for c in np.unique(own):
            mine, those = who[begin[c] : begin[c + 1]], np.flatnonzero(own == c)
            for first in range(0, len(those), BLOCK):
                some = those[first : first + BLOCK]
                for a in range(0, len(mine), BLOCK):
                    asks = mine[a : a + BLOCK]
                    scores = likenesses(rough[asks], fast[some], metric)
                    hit, where = best.above(scores, asks)
                    value = scores[hit, where] if metric != "cosine" else np.einsum("ij,ij->i", q[asks[hit]], x[some[where]])
                    best.add(asks[hit], value, at + rows[some[where]])
        kept.append(batch.column(0))
        at += batch.num_rows
        if len(kept) >= 16:
            hit, value, row = best.cut()
            used, back = np.unique(row, return_inverse=True)
            kept, at = [pa.concat_arrays(kept).take(pa.array(used))], len(used)
            best.found = [(hit, value, back)]
    if kept:
        hit, value, row = best.cut()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), pa.concat_arrays(kept).take(pa.array(row)), pa.array(value)], ["query_id", "node_id", "score"])


class VectorIndex:
    """Vectors below a path: cells/cell=<n> and about, a row with the centers and how to search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, vectors: DataFrame, path: str, metric: str = "cosine", cells: int | None = None) -> VectorIndex:
        """A new index of vectors (node_id, embedding). Null vectors, those with nulls, and those of another length than
        most of the sample are not in it; repeated rows are rows of their own."""
        if metric not in ("cosine", "l2", "ip"):
            raise ValueError(metric)
        index, spark = cls(vectors.sparkSession, path), vectors.sparkSession
        rows = vectors.where(F.size("embedding") > 0).select("node_id", "embedding")
        norm = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
        n, longest = rows.agg(F.count("*"), F.sqrt(F.max(norm))).first()
        draw = F.pmod(F.xxhash64("node_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / max(n, SAMPLE))
        sample = rows.where(draw).select("embedding").toArrow().column(0) if n else None
        widths = np.bincount([len(v) for v in sample.to_pylist()]) if sample is not None and len(sample) else np.zeros(1, int)
        x, width = (matrix(sample, int(widths.argmax()))[0], int(widths.argmax())) if widths.any() else (np.zeros((0, 1)), 0)
        x = _placed(x, metric, longest or 0.0)
        cells = max(1, min(cells or int(np.sqrt(n)), len(x) // FEWEST or 1))
        centers = fitted(x, cells) if len(x) else np.zeros((1, x.shape[1]))
        probes = probes_for(x, centers, metric) if len(x) > 1 else 1
        kind = dict(rows.dtypes)
        celled = rows.mapInArrow(lambda it: _celled(it, centers, metric, longest or 0.0, width), f"cell int, node_id {kind['node_id']}, embedding {kind['embedding']}")
        # ranges of cells and ids, so that a cell of many rows comes into several files
        celled.repartitionByRange("cell", "node_id").sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{index.path}/cells")
        about = [(metric, width, probes, kind["node_id"], kind["embedding"], centers.tolist())]
        spark.createDataFrame(about, "metric string, width int, probes int, id_kind string, kind string, centers array<array<double>>").coalesce(1).write.parquet(f"{index.path}/about")
        return index

    def search_each(self, queries: DataFrame, k: int = 10, probes: int | None = None, least: float | None = None) -> DataFrame:
        """(query_id, node_id, score): some k best for each of queries (query_id, embedding), of the probes nearest cells; ties by node_id.

        With least, only scores of that or more. Queries go to all tasks, TOGETHER in a pass, whose results are written
        before the next begins; only the cells that one of a pass's queries looks at are read, each by as many tasks as
        it has parts. Queries of another length give no rows. With as many probes as cells it is exact.
        """
        about = self.spark.read.parquet(f"{self.path}/about").first()
        centers, metric = np.array(about.centers), about.metric
        schema = f"cell int, node_id {about.id_kind}, embedding {about.kind}"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/cells").select("node_id", "embedding", "cell")
        out = f"query_id {dict(queries.dtypes)['query_id']}, node_id {about.id_kind}, score double"
        passes = max(1, -(-queries.count() // TOGETHER)) if about.width else 0
        asked, n, written = queries.select("query_id", "embedding"), min(probes or about.probes, len(centers)), False
        if passes > 1:  # so that a pass reads its own queries alone
            dealt, found = shared_dir(self.spark, "queries"), shared_dir(self.spark, "nearest")
            asked.withColumn("pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)).cast("int")).repartition("pass").write.partitionBy("pass").parquet(dealt)
            asked = self.spark.read.schema(f"{out.split(',')[0]}, embedding {dict(queries.dtypes)['embedding']}, pass int").parquet(dealt)
        for at in range(passes):
            table = (asked.where(F.col("pass") == at).drop("pass") if passes > 1 else asked).toArrow()
            q, own = matrix(table.column("embedding"), about.width)
            if not len(q):
                continue
            ids = table.column("query_id").combine_chunks().take(pa.array(own))
            probed = np.concatenate([np.argpartition(_by_distance(_asked(q[i : i + BLOCK], metric), centers), n - 1, 1)[:, :n].astype(np.int16 if len(centers) < 1 << 15 else np.int32) for i in range(0, len(q), BLOCK)])
            some = rows.where(F.col("cell").isin(np.unique(probed).tolist())) if n < len(centers) else rows
            some = some.coalesce(self.spark.sparkContext.defaultParallelism)  # each task hands on the best of each query
            some = some.mapInArrow(lambda it, a=(ids, q, probed, len(centers)): _searched(it, *a, k, metric, -np.inf if least is None else least), out)
            some = best_each(some.withColumn("score", F.round("score", 6)), k)
            some = some if least is None else some.where(F.col("score") >= least)
            if passes == 1:
                return some
            some.write.mode("append").parquet(found)
            written = True
        return self.spark.read.schema(out).parquet(found) if written else self.spark.createDataFrame([], out)
