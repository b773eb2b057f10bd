"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets share a budget of words by weight, none above a multiple of its source's size. Blocks of equally many words go
to sources by the highest quotients target / (2k - 1), then within a source to its shards the same way. A shard lays
its documents out in a seeded order and takes its blocks from a seeded start on, round and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import BROADCAST_IDS, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SHARD_WORDS = 1 << 20
#: At most so many shards a source; each is one group of a window.
MAX_SHARDS = 4096
MAX_BLOCK = 512
#: The block is the budget over so many blocks for each source, between 1 and MAX_BLOCK words.
BLOCKS_A_SOURCE = 1000
#: Sources, one small row each, that may be broadcast.
BROADCAST_SOURCES = 100_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def seeded(*parts: Column, seed: str = SEED) -> Column:
    """A number below 2**32 from a seed and parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) with sid, weight, budget and target.

    Sources by code point, null last, get the weights in turn. Sorted by how soon weight reaches their cap, the first
    source that the remaining budget doesn't fill sets the level at which all later ones share by weight. The windows
    run over one row for each source.
    """
    every = W.partitionBy()
    x = sources.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    x = x.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    x = x.withColumn("most", F.col("source_size") * cap).withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    order = W.orderBy(F.col("most") / F.col("weight"), "sid")
    x = x.withColumn("filled", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open"))
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(every)
    target = F.coalesce(F.least(reached * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    return x.select("source", "source_size", "sid", "weight", "budget", target.alias("target"))


def apportion(parties: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """Integer seats for each party of a group by the highest quotients weight / (2k - 1); ties go to the lower key.

    No quotient that surely wins is enumerated: dividing by total / (seats - n/2) gives too few seats in all and by
    total / (seats + n/2) too many, n being the number of parties, so only some 2n quotients of a group are ranked.
    """
    own = W.partitionBy(group)
    x = parties.withColumn("n_", F.count("*").over(own)).withColumn("all_", F.sum(weight).over(own))
    fair = lambda add: F.col(weight) * (F.col(seats) + add * F.col("n_") / 2) / F.col("all_")
    x = x.withColumn("low_", F.when(F.col(weight) > 0, F.greatest(F.floor(fair(-1) + 0.5) - 1, F.lit(0))).otherwise(0).cast("long"))
    x = x.withColumn("high_", F.when(F.col(weight) > 0, F.floor(fair(1) + 0.5) + 1).otherwise(0).cast("long"))
    x = x.withColumn("left_", F.col(seats) - F.sum("low_").over(own))
    k = x.where("high_ > low_").withColumn("k_", F.explode(F.sequence(F.col("low_") + 1, F.col("high_"))))
    won = F.row_number().over(own.orderBy(F.desc(F.col(weight) / (2 * F.col("k_") - 1)), key, "k_")) <= F.col("left_")
    k = k.withColumn("won_", won.cast("long")).groupBy(group, key).agg(F.sum("won_").alias("more_"))
    x = x.join(k, [group, key], "left").withColumn("quota", F.col("low_") + F.coalesce("more_", F.lit(0)))
    return x.drop("n_", "all_", "low_", "high_", "left_", "more_")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, size, source_size, target, taken.

    size counts the words of the text (null: 0), target is the source's, taken is how many words the mix takes from
    the document with repeats. A null source is a source of its own. Rows that repeat are documents of their own, also
    where they share a doc_id. Other columns are ignored; an empty table gives an empty result. Only functions of
    Spark's own are used, and the same rows give the same result however they are dealt.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = staged(docs.select("doc_id", "source", size.alias("size")), "sizes")
    sources = staged(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "sources")
    n = sources.count()
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.col("budget") / (BLOCKS_A_SOURCE * max(n, 1)))))
    quotas = sources.withColumn("block", block).withColumn("all", F.lit(0)).withColumn("total", F.sum("target").over(W.partitionBy("all")))
    quotas = apportion(quotas.withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long")), "all", "sid", "target", "seats")
    quotas = quotas.withColumn("shards", F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))))
    quotas = quotas.select("source", "source_size", "sid", "target", "block", "shards", F.col("quota").alias("blocks"))
    dealt = sizes.alias("d").join((F.broadcast(quotas) if n <= BROADCAST_SOURCES else quotas).alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
    dealt = dealt.select("doc_id", "size", "source_size", "sid", "target", "block", "blocks", (seeded(F.col("doc_id"), seed=seed) % F.col("shards")).alias("shard"))

    shards = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
    shards = apportion(shards, "sid", "shard", "shard_size", "blocks").select("sid", "shard", "shard_size", "quota")
    line = W.partitionBy("sid", "shard").orderBy(seeded(F.lit("order"), F.col("doc_id"), seed=seed), "doc_id", "size")
    x = dealt.join(shards, ["sid", "shard"]).withColumn("end", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.greatest("shard_size", F.lit(1))
    words = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * cap)
    start = (seeded(F.lit("start"), F.col("sid"), F.col("shard"), seed=seed) % F.ceil(whole / F.col("block"))) * F.col("block")
    x = x.withColumn("rounds", F.floor(words / whole)).withColumn("rest", words % whole).withColumn("start", start)
    inside = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest(F.col("end") - F.col("size"), a))
    stop = F.col("start") + F.col("rest")
    part = inside(F.col("start"), F.least(stop, whole)) + inside(F.lit(0), stop - whole)
    return x.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them: parts of a text of half of it or more count as one.

    Rows that share a doc_id are taken as often as the one taken most. Rows without doc_id, and without words, are left out.
    """
    size = F.greatest("size", F.lit(1))
    times = mix(docs, **how).select("doc_id", F.round(F.col("taken") / size).cast("int").alias("times")).where("times > 0")
    times = staged(times.groupBy("doc_id").agg(F.max("times").alias("times")), "times")
    if times.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        times = F.broadcast(times)
    ids = times.withColumnsRenamed({"doc_id": "mix_doc_id_", "times": "mix_times_"})
    rows = docs.join(ids, docs["doc_id"] == ids["mix_doc_id_"])
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("mix_times_"))).alias("mix_copy_")).drop("mix_copy_")
