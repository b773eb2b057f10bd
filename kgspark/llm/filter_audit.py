"""How filters interact: what each removes, after which others, and which labelled documents go with it.

Each filter has a table of the ids that fail it. A filter's ids are joined with the tables of the filters before it: a
left-anti join leaves what it still removes, a left-semi join what went already. Both depend on the set of filters in
front alone, so five tables and their sixteen sets give all orders; the orders themselves are put together from counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import shared_dir, staged

FILTERS = "ABCDE"
BREAK = r"[\x20\x09-\x0D]+"
#: Texts with over one in so many of all rows count as crowded.
CROWDS = 1000
#: Classes (part, filter, set of filters before), a small row each, that may be broadcast.
BROADCAST_CLASSES = 200_000


def conditions(text: Column) -> dict[str, Column]:
    """When a text fails the filters that look at one text alone."""
    words = F.filter(F.split(text, BREAK), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, good, toxic, failing) for each row of docs, with a number of its own; failing lists the letters of its filters.

    part is the lang, '' for null. A document is good or toxic if a row of labels with its doc_id says so.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    alone = F.array(*[F.when(c, F.lit(f)) for f, c in conditions(text).items()])
    x = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), alone.alias("alone"), F.sha2(text, 256).alias("mark"))
    x = staged(x.withColumn("row", F.monotonically_increasing_id()), "filtered")
    # the smallest id of each text that several rows have; counted before it is dealt out
    firsts = staged(x.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1"), "firsts")
    n = x.count()
    # no more than CROWDS texts have over 1 / CROWDS of all rows each; these rows stay where they are
    crowd = F.broadcast(firsts.where(F.col("times") > n / CROWDS))
    few = firsts.where(F.col("times") <= n / CROWDS)
    own = x.select("row", "doc_id", "mark")
    copies = own.join(crowd, "mark").unionByName(own.join(crowd, "mark", "left_anti").join(few, "mark"))
    copies = copies.where("doc_id > first").select("row", F.lit("E").alias("copy"))
    x = x.join(kinds, "doc_id", "left").join(copies, "row", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return x.select("row", "part", no("good"), no("toxic"), F.array_compact(F.concat("alone", F.array("copy"))).alias("failing"))


def failing_ids(audit: DataFrame) -> dict[str, DataFrame]:
    """The table (row, part, good, toxic) of each filter's failing rows, stored in a folder of its own."""
    spark, path = audit.sparkSession, shared_dir(audit.sparkSession, "failing")
    rows = audit.select("row", "part", "good", "toxic", F.explode("failing").alias("filter"))
    rows.write.partitionBy("filter").parquet(path)
    held = spark.read.schema("row long, part string, good boolean, toxic boolean, filter string").parquet(path)
    return {f: held.where(F.col("filter") == f).drop("filter") for f in FILTERS}


def by_set(failing: dict[str, DataFrame]) -> DataFrame:
    """(part, filter, before, removed, redundant, good_lost, toxic_lost): counts of a filter's ids behind each set of other filters.

    before has bit k set if the k-th filter is in front. Rows are dealt by id once; each is then looked at behind every
    set, next to the few rows of the same id.
    """
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    every = reduce(DataFrame.unionByName, [df.withColumn("filter", F.lit(f)) for f, df in failing.items()]).repartition("row")
    own = F.element_at(F.create_map(*[F.lit(x) for f in FILTERS for x in (f, bit[f])]), F.col("filter"))
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda s: s.bitwiseAND(own) == 0)
    asked = every.withColumn("before", F.explode(sets))
    other = every.select("row", own.alias("bit")).alias("o")
    # the comparison is no equality of columns, so that rows are joined by id alone and stay where they are
    hit = (F.col("a.row") == F.col("o.row")) & (F.col("a.before").bitwiseAND(F.col("o.bit")) > 0)
    left = asked.alias("a").join(other, hit, "left_anti").groupBy("part", "filter", "before")
    left = left.agg(F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    gone = asked.alias("a").join(other, hit, "left_semi").groupBy("part", "filter", "before").agg(F.count("*").alias("redundant"))
    return left.join(gone, ["part", "filter", "before"], "full")


def orders() -> list[tuple[str, int, str, int, int]]:
    """(order, step, filter, set before, all other filters) for each place of every order."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(p), k + 1, f, sum(bit[g] for g in p[:k]), sum(bit.values()) - bit[f]) for p in permutations(FILTERS) for k, f in enumerate(p)]


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part of docs (doc_id, text, lang), order of the filters and step, zeros included: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley, counts within the part.

    labels is (doc_id, quality, toxic); documents without one are neither good nor toxic, several of one id count if
    any says so. Null texts are empty and, with empty ones, copies of each other. Repeated rows are documents of their
    own; only a larger doc_id makes one a copy, so rows of one id never fail E by each other, and a null id never does.
    Other columns are ignored; an empty table gives an empty result.
    """
    audit = staged(audited(docs, labels), "audit")
    classes = staged(by_set(failing_ids(audit)), "classes")
    if classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        classes = F.broadcast(classes)
    n = len(FILTERS)
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (F.bit_count("before") + 1).cast("int"))
    value = classes.groupBy("part", "filter").agg(F.sum(weight * F.coalesce("removed", F.lit(0))).alias("shapley"))
    alone = classes.where(F.bit_count("before") == n - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, filter string, before int, others int")
    x = audit.groupBy("part").agg(F.count("*").alias("total")).crossJoin(F.broadcast(steps))
    x = x.join(classes, ["part", "filter", "before"], "left").join(value, ["part", "filter"], "left").join(alone, ["part", "filter"], "left")
    upto = W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    x = x.withColumn("kept", F.col("total") - F.sum(F.coalesce("removed", F.lit(0))).over(upto))
    return x.select("part", "filter_order", "step", *map(zero, ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


def survivors(docs: DataFrame, order: str) -> DataFrame:
    """The rows of docs, with all their columns, that pass the filters in order (some of FILTERS), by the same rules as interactions."""
    text = F.coalesce("text", F.lit(""))
    x = docs
    for f in order:
        if f != "E":
            x = x.where(~conditions(text)[f])
    if "E" in order:
        firsts = docs.groupBy(F.sha2(text, 256).alias("mark_")).agg(F.min("doc_id").alias("first_"), F.count("*").alias("times_")).where("times_ > 1")
        firsts = firsts.select("mark_", "first_")
        x = x.join(firsts, (F.sha2(text, 256) == firsts["mark_"]) & (x["doc_id"] > firsts["first_"]), "left_anti")
    return x
