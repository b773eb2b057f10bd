"""Sharding by sampled splitters, with Spark's own functions alone.

Rows are put in order of a key: a hash of the text, then doc_id, so that equal texts stand together. Sizes weigh how
often a row's key is drawn; quantiles of the draws part the keys into ranges of some equal size, and a range that turns
out too large, as one key may, is divided further. Ranges are numbered through by their totals, which gives each row
its place among all; the shards' boundaries are quantiles of size at these places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import shared_dir, staged

SHARDS = 40
#: Bytes beside the text that a row counts for.
ROW_BYTES = 16
#: A range holds some so many bytes; there are RANGES_A_SHARD for each shard at least, and MAX_RANGES at most.
RANGE_BYTES = 64 << 20
RANGES_A_SHARD = 4
MAX_RANGES = 1 << 16
#: Draws for each range; their number bounds the sample.
DRAWS = 32
#: A range over so many times the mean is divided.
OVERFULL = 3
#: Keys are found among the splitters of their first bits.
HEAD_BITS = 12
#: Texts whose copies take up to one part in so many of a shard's size are not parted by a boundary.
GROUP_PARTS = 200
#: Rows of a file that write_shards writes.
FILE_ROWS = 100_000


def key_of(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, size, text_crc32, key) of each row of docs (doc_id, text); row is a number of its own if none is given."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce("text", F.lit(""))
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key_of(text).alias("key"))


def splitters(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """(head, below, cuts): of up to ranges - 1 keys (key, doc_id) at equal steps of weight, those with the same first
    bits in order, and how many there are with smaller ones. total is the sum of weight.

    A row is drawn as often as its weight over the step has whole parts, and once more with the chance of the rest,
    decided by a hash. So the draws, some DRAWS * ranges, are the same in every run over the same rows.
    """
    chance = F.xxhash64("key", "doc_id", "row", F.lit("draw")).bitwiseAND((1 << 52) - 1) / float(1 << 52)
    times = F.floor(F.col("weight") * (DRAWS * ranges / max(total, 1)) + chance).cast("int")
    drawn = rows.withColumn("times", times).where("times > 0").select("key", "doc_id", F.explode(F.sequence(F.lit(1), "times")).alias("k"))
    place = F.row_number().over(W.orderBy("key", F.asc_nulls_first("doc_id")))
    cut = drawn.withColumn("place", place).where(F.col("place") % DRAWS == 0).select("key", "doc_id").distinct()
    cut = cut.groupBy(head(F.col("key")).alias("head")).agg(F.sort_array(F.collect_list(F.struct("key", "doc_id"))).alias("cuts"))
    heads = rows.sparkSession.range(1 << HEAD_BITS).select(F.col("id").alias("head")).join(cut, "head", "left")
    cuts = F.coalesce("cuts", F.array().cast("array<struct<key: long, doc_id: long>>"))
    below = F.coalesce(F.sum(F.size(cuts)).over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return heads.select("head", below.alias("below"), cuts.alias("cuts"))


def head(key: Column) -> Column:
    """The first bits of a key."""
    return F.shiftright(key, 60 - HEAD_BITS)


def ranged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with the number of their range: how many splitters are not above their key. One row a head is broadcast."""
    own = F.struct("key", "doc_id")
    x = rows.withColumn("head", head(F.col("key"))).join(F.broadcast(cuts), "head")
    under = F.filter("cuts", lambda c: c <= own)
    last = F.get(under, F.size(under) - 1)
    return x.withColumn("range", F.col("below") + F.size(under)).withColumn("edge", F.coalesce(last == own, F.lit(False))).drop("head", "below", "cuts")


def divided(rows: DataFrame, mean: float) -> DataFrame:
    """rows with sub: parts of the ranges over OVERFULL times the mean weight.

    Only rows with the very key that a range starts with can make it so large; they are equal but for their number, which
    deals them to the parts in front. The ranges' totals, a row each, are broadcast.
    """
    full = rows.groupBy("range").agg(F.sum("weight").alias("held")).where(F.col("held") > OVERFULL * mean)
    full = full.select("range", F.ceil(F.col("held") / max(mean, 1.0)).cast("int").alias("pieces"))
    x = rows.join(F.broadcast(full), "range", "left")
    sub = F.when(F.col("pieces").isNull(), 0).when(F.col("edge"), F.pmod(F.xxhash64("row"), F.col("pieces"))).otherwise(F.col("pieces"))
    return x.withColumn("sub", sub.cast("int")).drop("pieces", "edge")


def placed(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """rows (key, doc_id, row, weight ...) with place, from 0, and end, the sum of weight up to it, in order of key and doc_id over all rows."""
    x = staged(divided(ranged(rows, splitters(rows, ranges, total)), total / ranges), "ranged")
    up = W.orderBy("range", "sub").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    cells = x.groupBy("range", "sub").agg(F.count("*").alias("n"), F.sum("weight").alias("held"))  # a few rows a range
    cells = cells.select("range", "sub", before("n").alias("rows_before"), before("held").alias("held_before"))
    line = W.partitionBy("range", "sub").orderBy("key", F.asc_nulls_first("doc_id"), "row")
    x = x.join(F.broadcast(cells), ["range", "sub"])
    x = x.withColumn("place", F.col("rows_before") + F.row_number().over(line) - 1)
    x = x.withColumn("end", F.col("held_before") + F.sum("weight").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return x.drop("range", "sub", "rows_before", "held_before")


def together(x: DataFrame, n: int, total: int) -> DataFrame:
    """x (key, shard, weight, end ...) with the copies of a text that a boundary parts in the shard of their middle, if they take up to 1 / GROUP_PARTS of a shard."""
    sides = x.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))  # a row for each shard
    ends = sides.select(F.col("shard").alias("of"), F.explode(F.array("low", "high")).alias("key")).distinct()
    asked = ends.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    parted = x.join(F.broadcast(asked), "key").groupBy("key").agg(F.sum("weight").alias("all"), F.max("end").alias("upto")).where(F.col("all") * (n * GROUP_PARTS) <= total)
    moved = parted.select("key", F.expr(f"cast(least((2 * upto - all) * {n} div {2 * total}, {n - 1}) as int)").alias("moved"))
    return x.join(F.broadcast(moved), "key", "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved")


def assigned(rows: DataFrame, n: int = SHARDS, law: str = "bytes") -> DataFrame:
    """rows (row, doc_id, key, size ...) with shard and slot; see shards."""
    if law not in ("bytes", "rows"):
        raise ValueError(law)
    rows = rows.withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long"))
    size, total = rows.agg(F.sum("size"), F.sum("weight")).first()
    ranges = min(MAX_RANGES, max(RANGES_A_SHARD * n, (size or 0) // RANGE_BYTES))
    x = staged(placed(rows, ranges, total or 0), "placed")
    # the shard of a row's middle; with weights of one, counts are at most one apart
    x = x.withColumn("shard", F.expr(f"cast(least((2 * end - weight) * {n} div {2 * (total or 1)}, {n - 1}) as int)"))
    if law == "bytes":
        x = together(x, n, total or 1)
    starts = x.groupBy("shard").agg(F.min("place").alias("start"))  # a row for each shard
    x = x.join(F.broadcast(starts), "shard").withColumn("slot", (F.col("place") - F.col("start")).cast("long"))
    return x.drop("place", "end", "start", "weight")


def shards(docs: DataFrame, n: int = SHARDS, law: str = "bytes") -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law bytes gives shards of nearly equal size: none differs from the mean by more than half of the documents at its
    two ends and of the copies moved there. Law rows gives counts of rows that are at most one apart. In both, equal
    texts stand side by side, by doc_id; copies that take up to 1 / GROUP_PARTS of a shard's size are not parted by law
    bytes, larger groups are. slot numbers a shard's rows from 0. grown_shard is null, as another number of shards moves
    the boundaries. size is ROW_BYTES and the bytes of the text, none if null. Rows that repeat are rows of their own,
    null ids come first among equal texts; other columns are ignored; an empty table gives an empty result.
    """
    x = assigned(staged(measured(docs), "measured"), n, law)
    return x.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, n: int = SHARDS, law: str = "bytes", path: str | None = None) -> str:
    """Write docs with all their columns as Parquet, a folder shard_=k for each shard with slot_ beside them; returns the path.

    A shard is written in files of up to FILE_ROWS rows, each in order of slot.
    """
    path = path or shared_dir(docs.sparkSession, "shards")
    own = staged(docs.select(F.monotonically_increasing_id().alias("row_"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_")), "numbered")
    rows = measured(own.select("row_", F.col("own_.doc_id").alias("doc_id"), F.col("own_.text").alias("text")), F.col("row_"))
    dealt = assigned(staged(rows, "measured"), n, law).select(F.col("row").alias("row_"), F.col("shard").alias("shard_"), F.col("slot").alias("slot_"))
    x = own.join(dealt, "row_").select("own_.*", "shard_", "slot_")
    x = x.repartition("shard_", F.floor(F.col("slot_") / FILE_ROWS)).sortWithinPartitions("shard_", "slot_")
    x.write.partitionBy("shard_").parquet(path)
    return path
