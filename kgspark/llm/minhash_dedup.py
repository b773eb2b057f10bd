"""Near-duplicates by bottom-k sketches from one hash function.

A document's sketch holds its k smallest shingle hashes. Inverted lists of the retained values give overlaps, the
bottom-k sketch of a pair's union estimates its Jaccard similarity, and full shingle sets confirm every link.

Documents with equal sets form a class; only one of each class goes on, so exact copies never meet. Retained values
that no other class has are dropped; of the rest, each class is listed under its rarest ones only: a pair that shares
at least t retained values shares one among the (size - t + 1) rarest of both. t is chosen so that a pair at the
threshold falls short of it with a chance under 1e-9; for sets that fit into the sketch it is exact. Each list's
smallest member is compared with the others first; then only pairs that these links have not yet brought together are
compared, so a list of thousands of near copies costs a link for each, not one for each pair. Members of a list that
still holds many pairs are told apart by what sets them apart from one of them, see crowd_links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import components, least_hits, narrowed, rows_of, staged, without
from kgspark.llm.shingles import overlap, shingle_set

K = 64
#: Rounds in which each list's members are compared with one of them before all that is left is.
PIVOT_ROUNDS = 2
#: Pairs that a list may still hold then; the members of one with more are listed anew by what sets them apart.
DENSE = 200
#: Similarity in hundredths.
PERCENT = 75


def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_of(batches, "doc_id", "text"):
        size, key, sketch = [], [], []
        for s in map(shingle_set, texts):  # no set is kept beside the next one
            size.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketch.append(s[:k].copy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_key", "sketch"],
        )


def features(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets) and the bottom-k sketch of each row's text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _features(it, k), "doc_id long, n_shingles long, set_key binary, sketch array<long>"
    )


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    last, left = None, None
    for a, text_a, b, text_b in rows_of(batches, "a", "text_a", "b", "text_b"):
        found = []
        for x, tx, y, ty in zip(a, text_a, b, text_b, strict=True):
            if last is None or tx != last:
                last, left = tx, shingle_set(tx)
            right = shingle_set(ty)
            both = overlap(left, right)
            if 100 * both >= percent * (len(left) + len(right) - both) > 0:
                found.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    texts = narrowed(docs.select("doc_id", "text"), pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "doc_id")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "text_a", "b", "text_b")
    return both.mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")


def _plausible(pairs: DataFrame, reps: DataFrame, k: int, percent: int, hits: int) -> DataFrame:
    """The pairs whose union's bottom-k sketch has enough values that both have."""
    sk = reps.select("rep", "sketch")
    x = pairs.join(sk.select(F.col("rep").alias("a"), F.col("sketch").alias("s")), "a")
    x = x.join(sk.select(F.col("rep").alias("b"), F.col("sketch").alias("z")), "b")
    x = x.select("a", "b", F.array_intersect("s", "z").alias("both"), F.slice(F.array_sort(F.array_union("s", "z")), 1, k).alias("low"))
    x = x.select("a", "b", F.size("low").alias("n"), F.size(F.array_intersect("both", "low")).alias("hits"))
    return x.where((F.col("hits") >= hits) | ((F.col("n") < k) & (100 * F.col("hits") >= percent * F.col("n")))).select("a", "b")


def rare_lists(values: DataFrame) -> DataFrame:
    """(value, rep, n, shared): each class (rep, n, need, value) under as many of its rarest values as its need leaves.

    Values of one class alone are dropped; a class left with fewer values than it needs to share is in no list. shared
    grows with how common all of its values are.
    """
    common = values.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1")
    own = W.partitionBy("rep", "n")
    listed = values.join(common, "value").withColumn("have", F.count("*").over(own)).where("have >= need")
    listed = listed.withColumn("shared", F.sum(F.log("lists")).over(own)).withColumn("rank", F.row_number().over(own.orderBy("lists", "value")))
    return staged(listed.where("rank <= have - need + 1").select("value", "rep", "n", "shared", "have", "rank"), "lists")


def open_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the same list, of sizes that can be similar enough."""
    x = left.where("not in_main").select("value", F.col("rep").alias("x"), F.col("n").alias("n_a"), F.col("component").alias("cx"))
    y = left.select("value", "rep", "n", "component", "in_main")
    near = F.least("n_a", "n") * 100 >= F.greatest("n_a", "n") * percent
    rest = x.join(y, "value").where(near & (F.col("cx") != F.col("component")) & (F.col("in_main") | (F.col("x") < F.col("rep"))))
    return rest.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_of(batches, "doc_id", "text"):
        sets = [shingle_set(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "n", "set"])


def around(docs: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """The members of dense lists as what sets them apart from their list's center, the one with the most common values.

    (p, rep, n, n_p, component, tied, x): x are the shingles that only one of p and rep has, so of two members of one
    center these differ by just what their sets differ by. tied: like enough to p, or of its component.
    """
    center = F.max_by(F.struct(F.col("rep").alias("p"), F.col("n").alias("n_p"), F.col("component").alias("c_p")), F.struct("shared", (-F.col("rep")).alias("rep")))
    member = dense.join(dense.groupBy("value").agg(center.alias("c")), "value").select("c.*", "rep", "n", "component").where("p <> rep").distinct()
    sets = narrowed(docs.select("doc_id", "text"), dense.select(F.col("rep").alias("doc_id")), "doc_id")
    sets = staged(sets.mapInArrow(_sets, "rep long, n long, set array<long>").dropDuplicates(["rep"]), "sets").select("rep", "set")
    x = member.join(sets, "rep").join(sets.select(F.col("rep").alias("p"), F.col("set").alias("s")), "p")
    x = x.withColumn("x", F.array_union(F.array_except("set", "s"), F.array_except("s", "set"))).drop("set", "s")
    tied = (F.col("component") == F.col("c_p")) | alike(F.size("x"), F.col("n") + F.col("n_p"), percent)
    return staged(x.select("p", "rep", "n", "n_p", "component", tied.alias("tied"), "x"), "around")


def alike(apart, sizes, percent: int):
    """Whether sets of these sizes (the sum of both), that differ by so many values, are similar enough."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def around_lists(members: DataFrame, percent: int) -> DataFrame:
    """The members under the rarest values of x, as many as a pair with one that is not tied leaves to choose from.

    Sets of n and m that are alike differ by (n + m) * rate at most. One that is not tied is more than that from the
    center, so what both are from it must coincide in part: in half of what is left when the rate's share is taken off.
    """
    rate = (100 - percent) / (100 + percent)
    m = F.size("x")
    need = F.when(F.col("tied"), m + rate * (F.col("n_p") - F.col("n"))).otherwise(m - rate * (F.col("n_p") + F.col("n"))) / 2
    values = members.select("p", "rep", "n", "component", "tied", m.alias("m"), F.greatest(F.ceil(need - 1e-6), F.lit(1)).alias("need"), F.explode("x").alias("value"))
    values = values.withColumn("value", F.xxhash64("p", "value"))
    common = values.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1")
    own = W.partitionBy("p", "rep")
    listed = values.join(common, "value").withColumn("have", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("lists", "value")))
    listed = listed.withColumn("rest", F.col("have") - F.col("rank") + 1).where("rest >= need")
    return staged(listed.select("value", "p", "rep", "n", "m", "component", "tied", "rest"), "lists")


def around_links(members: DataFrame, lists: DataFrame, percent: int, one: bool) -> DataFrame:
    """Links of members of different components in one list; with one, only those of a member of each list that is not tied."""
    rate = (100 - percent) / (100 + percent)
    a = lists.where("not tied").select("value", F.struct(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("m").alias("m_a"), F.col("component").alias("c_a"), F.col("rest").alias("rest_a")).alias("y"))
    if one:
        a = a.groupBy("value").agg(F.max_by("y", F.struct("y.rest_a", -F.col("y.a"))).alias("y"))
    a = a.select("value", "y.*")
    enough = 2 * F.least("rest", "rest_a") >= F.col("m") + F.col("m_a") - rate * (F.col("n") + F.col("n_a")) - 1e-6
    each = F.lit(True) if one else F.col("tied") | (F.col("a") < F.col("rep"))
    pairs = a.join(lists, "value").where(enough & each & (F.col("component") != F.col("c_a"))).select("p", "a", F.col("rep").alias("b")).distinct()
    x = members.select("p", "rep", "n", "x")
    both = pairs.join(x.toDF("p", "a", "n_a", "x_a"), ["p", "a"]).join(x.toDF("p", "b", "n_b", "x_b"), ["p", "b"])
    apart = F.size("x_a") + F.size("x_b") - 2 * F.size(F.array_intersect("x_a", "x_b"))
    return staged(both.where(alike(apart, F.col("n_a") + F.col("n_b"), percent)).select("a", "b"), "links")


def crowd_links(docs: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """Links between members of dense lists (value, rep, n, shared, component) that bring all of their components together.

    Near copies of one text share most of it with each other, so lists of what they share hold all pairs. What sets
    each apart from the list's center is spread over many values, and lists of these are short.
    """
    members = around(docs, dense, percent)
    links = members.where(F.col("tied")).select(F.col("p").alias("a"), F.col("rep").alias("b"))
    lists = around_lists(members, percent)
    some = around_links(members, lists, percent, True)
    joined = components(links.unionByName(some).unionByName(dense.select(F.col("rep").alias("a"), F.col("component").alias("b")))).withColumnRenamed("node", "rep")
    lists = staged(lists.drop("component").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "lists")
    return links.unionByName(some).unionByName(around_links(members, lists, percent, False))


def pivot_links(docs: DataFrame, lists: DataFrame, reps: DataFrame, k: int, percent: int, hits: int) -> DataFrame:
    """Confirmed links between each list's pivot and its other members outside the pivot's component.

    The pivot is the one outside the list's largest component, if it has been told, whose retained values are the most
    common ones: of a group of near copies that is the text they were made from, which resembles each of them more than
    they do each other.
    """
    order = F.struct("shared", (-F.col("rep")).alias("rep"))
    outside = lists if "in_main" not in lists.columns else lists.where("not in_main")
    pivot = outside.groupBy("value").agg(F.max_by(F.struct(F.col("rep").alias("p"), F.col("n").alias("n_a"), F.col("component").alias("c")), order).alias("pivot"))
    near = F.least("n_a", "n") * 100 >= F.greatest("n_a", "n") * percent
    pairs = lists.join(pivot.select("value", "pivot.*"), "value").where((F.col("component") != F.col("c")) & near)
    pairs = pairs.select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")).distinct()
    return staged(confirmed(docs, staged(_plausible(pairs, reps, k, percent, hits), "pairs"), percent), "links")


def _open(listed: DataFrame, joined: DataFrame) -> DataFrame:
    """The lists whose members are of several components, with these and whether each is the list's largest."""
    tagged = listed.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    groups = tagged.groupBy("value", "component").agg(F.count("*").alias("m"))
    main = groups.groupBy("value").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    return tagged.join(main.drop("groups"), "value").withColumn("in_main", F.col("component") == F.col("main")).drop("main")


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Null or blank texts have no shingles and are linked with nothing. Rows that share a doc_id are one document in
    the graph and keep a row each; a null doc_id is never linked, and its component_id is null. Other columns are
    ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = staged(features(docs, k), "sketches")
    classes = staged(
        feats.where("n_shingles > 0 and doc_id is not null").groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch")), "classes"
    )
    hits = least_hits(k, percent / 100)
    need = F.least(F.lit(hits), F.ceil(F.col("n_shingles") * percent / 100))
    listed = rare_lists(classes.select("rep", F.col("n_shingles").alias("n"), need.alias("need"), F.explode("sketch").alias("value")))
    reps = classes.join(listed.select("rep").distinct(), "rep", "left_semi")

    links = pivot_links(docs, listed.withColumn("component", F.col("rep")), reps, k, percent, hits)
    joined = components(links).withColumnRenamed("node", "rep")
    for _ in range(PIVOT_ROUNDS - 1):
        more = pivot_links(docs, _open(listed, joined), reps, k, percent, hits)
        links = links.unionByName(more)
        joined = components(links).withColumnRenamed("node", "rep")

    left = _open(listed, joined)
    cost = left.groupBy("value").agg(F.count_if(~F.col("in_main")).alias("others"), F.count("*").alias("m"))
    left = staged(left.join(cost.select("value", (F.col("others") * F.col("m") > DENSE).alias("dense")), "value"), "open")
    rest = _plausible(open_pairs(left.where("not dense"), percent), reps, k, percent, hits)
    more = staged(confirmed(docs, staged(rest, "pairs"), percent), "links")
    dense = left.where("dense")
    if not dense.isEmpty():
        more = more.unionByName(crowd_links(docs, dense, percent))
    if not more.isEmpty():
        joined = components(links.unionByName(more)).withColumnRenamed("node", "rep")

    belongs = feats.drop("sketch").join(classes.select("set_key", "rep"), "set_key", "left")
    belongs = belongs.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep"))).join(joined, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return belongs.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, less those that resemble one of a smaller doc_id, directly or by way of others."""
    return without(docs, near_duplicates(docs).where("not kept").select("doc_id"), "doc_id")
