"""I-Match fingerprints with randomised lexicons, from Spark's own functions alone.

A lexicon keeps the terms whose inverse document frequency lies in a band. A hash deals its terms to LEXICONS chains of
nested random subsets, at rates of powers of two; a document uses in each chain the subset whose rate suits its number
of terms, so that a term or two are expected of any document with enough terms, and the next smaller one. The sorted
distinct terms of the document in either subset are hashed. The chains' rates are shifted against each other, so that two texts of different size have
a subset in common in each chain unless one is over twice the other. The likeness of two fingerprints is the share of
chains with an equal hash among those that either has terms in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import staged

#: Terms of a document that the larger subset holds, at least, on average, before the band is applied.
PER_SUBSET = 1.0
#: ln(documents / documents with the term). The upper end bounds the lexicon: e**7 times a document's mean number of terms.
IDF_BAND = (1.0, 7.0)
#: Terms (8 bytes each) that may be broadcast; a larger lexicon is joined by shuffle.
BROADCAST_TERMS = 2_000_000
PARTS = r"[^\p{L}\p{N}]+"
#: Bits of a term's hash that deal it to a chain; the rest place it within the chain.
CHAIN_BITS = 4
LEXICONS = 1 << CHAIN_BITS


def terms(text: str | Column) -> Column:
    """The distinct lower-cased runs of letters and digits."""
    return F.filter(F.array_distinct(F.split(F.lower(text), PARTS)), lambda t: t != "")


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Hashes of the terms in the band, over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms("text")).alias("term")).groupBy(F.xxhash64("term").alias("term_hash")).agg(F.count("*").alias("docs"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("docs"))
    return counts.where((idf >= band[0]) & (idf <= band[1])).select("term_hash")


def _level(n: Column, chain: int) -> Column:
    """How often a chain's rate is halved for a document with n terms."""
    return F.floor(F.log2(F.greatest(n, F.lit(1))) + chain / LEXICONS)


def _ceilings(n: Column) -> Column:
    """For each chain, what the rest of a term's hash must stay under to be in the subset for a document with n terms."""
    rates = [F.pow(F.lit(2.0), F.lit(r / LEXICONS) - _level(n, r)) * PER_SUBSET * LEXICONS for r in range(LEXICONS)]
    return F.array(*[(F.least(rate, F.lit(1.0)) * float(1 << 64 - CHAIN_BITS)).cast("long") for rate in rates])


def _picked(found: Column, ceilings: Column) -> Column:
    """The terms in their chain's subset, with that chain and whether they are in its next smaller subset, too."""
    chain = lambda t: F.xxhash64(t).bitwiseAND(LEXICONS - 1).cast("int")
    rest = lambda t: F.shiftrightunsigned(F.xxhash64(t), CHAIN_BITS)
    inside = F.filter(found, lambda t: rest(t) < F.get(ceilings, chain(t)))
    return F.transform(inside, lambda t: F.struct(t.alias("term"), chain(t).alias("chain"), (rest(t) < F.shiftright(F.get(ceilings, chain(t)), 1)).alias("deep")))


def _signatures(found: Column, n: Column) -> Column:
    """For each chain the hashes of the terms in its subset and in the next, 'hash.hash', either '' if it holds none."""

    def one(r: int, deep: bool) -> Column:
        inside = F.transform(F.filter(found, lambda x: (x["chain"] == r) & (x["deep"] | F.lit(not deep))), lambda x: x["term"])
        return F.when(F.size(inside) > 0, F.hex(F.xxhash64(inside, _level(n, r) + int(deep)))).otherwise("")

    return F.array(*[F.concat(one(r, False), F.lit("."), one(r, True)) for r in range(LEXICONS)])


def likeness(a: str, b: str) -> Column:
    """From 0 to 1, of two fingerprints; equal ones are alike."""
    lists = [F.transform(F.split(x, "-"), lambda p: F.array_remove(F.split(p, r"\."), "")) for x in (a, b)]
    both = F.zip_with(*lists, lambda x, y: F.when(F.size(F.concat(x, y)) > 0, F.coalesce(F.arrays_overlap(x, y), F.lit(False)).cast("int")))
    both = F.filter(both, lambda x: x.isNotNull())
    share = F.aggregate(both, F.lit(0), lambda t, x: t + x) / F.size(both)
    listed = F.col(a).contains("-") & F.col(b).contains("-")
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(listed & (F.size(both) > 0), share).otherwise(0.0).cast("double")


def fingerprints(docs: DataFrame, parts: int | None = None, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    row's text by (doc_id, text), null ids first; after the last comes the first. A text none of whose terms is in its
    subsets gets a hash of all its terms in place of the list. Null texts are empty and have the fingerprint of no
    terms. Repeated rows are rows of their own. Other columns are ignored; an empty table gives an empty result.

    Rows are dealt to ranges of doc_id by approximate quantiles. One more row in each range, the first of the next,
    shows the last row its successor, so texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    docs = docs.withColumn("range", F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))
    docs = docs.withColumn("range", F.greatest("range", F.lit(0)))
    words = staged(lexicon(docs, band), "lexicon")
    words = F.broadcast(words) if words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else words

    heads = docs.groupBy("range").agg(F.min(F.struct(F.expr("doc_id is not null").alias("some"), "doc_id", "text")).alias("head"))
    every = W.orderBy("range")
    wrap = F.coalesce(F.lag("range").over(every), F.max("range").over(W.partitionBy()))
    heads = heads.select(wrap.alias("range"), "head.doc_id", "head.text", F.lit(True).alias("guest"))
    rows = docs.select("range", "doc_id", "text", F.lit(False).alias("guest")).unionByName(heads)
    line = W.partitionBy("range").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    rows = rows.withColumn("place", F.row_number().over(line)).withColumn("next", F.lead("text").over(line))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("range", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    versions = F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))))
    rows = rows.select("range", "place", "guest", "doc_id", "n_chars", versions.alias("v")).where("not (guest and v.which = 1)")
    rows = rows.select("range", "place", "guest", "doc_id", "n_chars", "v.which", F.when(F.col("v.which") == 1, F.sha2("v.text", 256)).alias("sha"), terms("v.text").alias("terms"))
    plain = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.xxhash64(t)))
    rows = rows.withColumn("n", F.size("terms")).withColumn("plain", F.when(F.col("n") > 0, F.hex(plain)).otherwise(""))
    rows = rows.withColumn("ceilings", _ceilings(F.col("n"))).withColumn("picked", _picked(F.col("terms"), F.col("ceilings"))).drop("terms", "ceilings")
    # a row stays where nothing is picked
    rows = rows.select("*", F.explode_outer("picked").alias("x")).drop("picked")
    rows = rows.withColumn("term_hash", F.coalesce(F.when(F.col("x").isNotNull(), F.xxhash64("x.term")), F.xxhash64("doc_id", "place", "which")))
    rows = rows.join(words.withColumn("kept", F.lit(True)), "term_hash", "left")
    found = lambda which: F.array_sort(F.collect_list(F.when((F.col("which") == which) & F.col("kept") & F.col("x").isNotNull(), F.col("x"))))
    of = lambda which, name: F.max(F.when(F.col("which") == which, F.col(name)))
    got = rows.groupBy("range", "place", "guest", "doc_id", "n_chars").agg(
        F.max("sha").alias("edited_sha256"), found(0).alias("own"), found(1).alias("other"), of(0, "plain").alias("own_plain"),
        of(1, "plain").alias("other_plain"), of(0, "n").alias("own_n"), of(1, "n").alias("other_n"),
    )
    shown = lambda sigs, plain: F.when(F.array_join(sigs, "") == "." * LEXICONS, F.concat(F.lit("all"), F.col(plain))).otherwise(F.array_join(sigs, "-"))
    got = got.withColumn("own", _signatures(F.col("own"), F.col("own_n"))).withColumn("other", _signatures(F.col("other"), F.col("other_n")))
    got = got.withColumn("fingerprint", shown(F.col("own"), "own_plain")).withColumn("edited_fingerprint", shown(F.col("other"), "other_plain"))
    got = got.withColumn("next_fingerprint", F.lead("fingerprint").over(W.partitionBy("range").orderBy("place"))).where("not guest")
    return got.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
