"""Entity resolution: spellings of one name found by vectors of their letters, decided pair by pair, and joined into one.

Names with the same normalized key are one from the start. Keys near each other are pairs to decide on; what is found
alike is joined over any number of steps, and each group is named by its most frequent, tidiest, longest spelling.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import normalized_key
from kgspark.operators.graph import ambiguous_first_names, canonical_names, components, rewritten
from kgspark.operators.vector_index import VectorIndex
from kgspark.sources.shared import shared_dir, staged

#: Length of the vectors of names.
WIDTH = 128


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_pylist()
        x = np.zeros((len(keys), WIDTH), np.float32)
        for row, key in zip(x, keys, strict=True):
            padded = f" {key} "
            for i in range(len(padded) - 2):
                row[zlib.crc32(padded[i : i + 3].encode()) % WIDTH] += 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["node_id", "embedding"])


def letter_vectors(keys: DataFrame) -> DataFrame:
    """(node_id, embedding) of keys (key): how often each hashed run of three letters stands in it."""
    return keys.select("key").mapInArrow(_lettered, "node_id string, embedding array<float>")


def near_pairs(vectors: DataFrame, n: int = 5, max_distance: float = 0.5) -> DataFrame:
    """(a, b, score), a < b: each of vectors (node_id, embedding) and its n nearest within a cosine distance, by an index of cells."""
    index = VectorIndex.create(vectors, shared_dir(vectors.sparkSession, "names"))
    pairs = index.search_each(vectors.withColumnRenamed("node_id", "query_id"), n + 1, least=1 - max_distance).where(F.col("query_id") != F.col("node_id"))
    return pairs.groupBy(F.least("query_id", "node_id").alias("a"), F.greatest("query_id", "node_id").alias("b")).agg(F.max("score").alias("score"))


def alike(a: Column, b: Column) -> Column:
    """Whether two keys are taken for one: up to a fifth of the letters differ, or one has all words of the other."""
    edits = F.levenshtein(a, b) * 5 <= F.greatest(F.length(a), F.length(b))
    x, y = F.split(a, " "), F.split(b, " ")
    return edits | (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def unguarded(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """pairs (a, b, ...) without those that have, on either side, a bare first name that several full names of all names (name) start with."""
    bare = staged(ambiguous_first_names(names).select(F.col("first").alias("a")), "first_names")
    return pairs.join(bare, "a", "left_anti").join(bare.withColumnRenamed("a", "b"), "b", "left_anti")


def resolved(names: DataFrame, n: int = 5, max_distance: float = 0.5, decide: Callable[[Column, Column], Column] = alike, vectors: Callable[[DataFrame], DataFrame] = letter_vectors) -> DataFrame:
    """(name, canonical) for each different name of names (name), which may repeat; names without letters or digits stay as they are.

    vectors gives (node_id, embedding) of keys (key), decide whether the keys of a pair are one. Two keys are a pair if one is
    among the n nearest of the other; an ambiguous bare first name is in none, so it is joined with nobody.
    """
    keyed = staged(names.where("name is not null").select("name", normalized_key(F.col("name")).alias("key")), "keyed")
    keys = staged(keyed.where("key <> ''").select("key").distinct(), "keys")
    pairs = unguarded(near_pairs(staged(vectors(keys), "vectors"), n, max_distance), keyed.select("name"))
    groups = components(pairs.where(decide(F.col("a"), F.col("b"))).select("a", "b"))
    grouped = keyed.join(groups.withColumnsRenamed({"node": "key"}), "key", "left").select("name", F.coalesce("component", "key").alias("key"))
    best = canonical_names(grouped).select("key", "canonical")
    each = grouped.distinct().join(best, "key", "left")
    return each.select("name", F.coalesce("canonical", "name").alias("canonical"))


def resolve(triples: DataFrame, types: list[str] | None = None, **how) -> DataFrame:
    """Triples (subject, subject_type, predicate, obj, obj_type) with both ends renamed to their canonical names.

    Only entities of the given types are resolved, all if none are; entities of different types never become one.
    """
    ends = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("obj").alias("name"), F.col("obj_type").alias("type")))).alias("x")).select("x.*")
    ends = staged(ends, "ends")
    for kind in types or [r[0] for r in ends.select("type").distinct().collect()]:
        to = staged(resolved(ends.where(F.col("type") == kind).select("name"), **how), "canonical")
        for end in ("subject", "obj"):
            own = triples.where(F.col(f"{end}_type").eqNullSafe(kind))
            rest = triples.where(~F.col(f"{end}_type").eqNullSafe(kind))
            triples = rest.unionByName(rewritten(own, to, [end]).select(*triples.columns))
    return triples
