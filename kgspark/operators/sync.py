"""Incremental change detection over snapshots of documents and a state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def content_hash(text: str = "text"):
    """SHA-256 of the UTF-8 text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, action): insert, update, delete or none, from the hashes of two snapshots (doc_id, content_hash)."""
    x = old.withColumnRenamed("content_hash", "was").join(new.withColumnRenamed("content_hash", "now"), "doc_id", "full")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "update").otherwise("none")
    return x.select("doc_id", action.alias("action"))


def should_process(changes: DataFrame, state: DataFrame, now: Column | None = None) -> DataFrame:
    """(doc_id, process, reason) for changes (doc_id, ordinal, content_hash) against the state (these and vector_synced_at).

    Unknown documents and changed contents are processed; older or equal ordinals and equal contents are not. A state
    without a hash is of a first bulk sync: if that was under five minutes before now, only the hash is to be put in,
    else the document is processed.
    """
    s = state.select("doc_id", F.col("ordinal").alias("had"), F.col("content_hash").alias("was"), F.col("vector_synced_at").alias("synced"), F.lit(True).alias("known"))
    fresh = F.col("synced") > (F.current_timestamp() if now is None else now) - F.expr("INTERVAL 5 MINUTES")
    reason = (
        F.when(F.col("known").isNull(), "new").when(F.col("ordinal") < F.col("had"), "older").when(F.col("ordinal") == F.col("had"), "same ordinal")
        .when(F.col("was").isNull() & fresh, "just synced").when(F.col("was").isNull(), "no hash yet")
        .when(F.col("content_hash") == F.col("was"), "same content").otherwise("changed")
    )
    x = changes.join(s, "doc_id", "left").withColumn("reason", reason)
    return x.select("doc_id", F.col("reason").isin("new", "no hash yet", "changed").alias("process"), "reason")


def upsert(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state with rows of new put in or over; a null source_id leaves the old one."""
    n = new.select("doc_id", F.col("source_id").alias("s"), F.col("content_hash").alias("h"), F.col("ordinal").alias("o"), F.lit(True).alias("hit"))
    x = state.join(n, "doc_id", "full")
    pick = lambda a, b: F.when(F.col("hit"), F.col(a)).otherwise(F.col(b))
    return x.select("doc_id", F.coalesce("s", "source_id").alias("source_id"), pick("h", "content_hash").alias("content_hash"), pick("o", "ordinal").alias("ordinal"))


def replace_by_document(rows: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of the documents in new replaced by those of new."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def sync_stats(state: DataFrame) -> DataFrame:
    """By source_id: documents, how many of each target are synced, and the share that all are."""
    done = F.col("vector_synced") & F.col("search_synced") & F.col("graph_synced")
    return state.groupBy("source_id").agg(
        F.count("*").alias("documents"), F.count_if("vector_synced").alias("vector"), F.count_if("search_synced").alias("search"), F.count_if("graph_synced").alias("graph"),
        F.round(100.0 * F.count_if(done) / F.count("*"), 2).alias("complete_pct"),
    )


def sync_gap(state: DataFrame) -> DataFrame:
    """(doc_id, gap): the first target that misses the document."""
    gap = F.when(~F.col("vector_synced"), "vector").when(~F.col("search_synced"), "search").when(~F.col("graph_synced"), "graph").otherwise("Complete")
    return state.select("doc_id", gap.alias("gap"))


def burst_collapse(events: DataFrame, seconds: float = 1) -> DataFrame:
    """Events (path, kind, ts, event_id) less each UPDATE within so many seconds after a CREATE of the same path."""
    w = W.partitionBy("path").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    x = events.withColumn("made", F.last(F.when(F.col("kind") == "CREATE", at), ignorenulls=True).over(w))
    return x.where((F.col("kind") != "UPDATE") | F.col("made").isNull() | (at - F.col("made") >= int(seconds * 1_000_000))).drop("made")


def source_share(state: DataFrame) -> DataFrame:
    """By config_id: documents, those with a source_id (of a cloud source) and their share in hundredths."""
    return state.groupBy("config_id").agg(F.count("*").alias("documents"), F.count("source_id").alias("with_source_id"), F.round(100.0 * F.count("source_id") / F.count("*"), 2).alias("cloud_pct"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, first, n) of the documents (doc_id, text) whose text others have too: the smallest id with it, and how many have it."""
    x = docs.where("text is not null").select("doc_id", content_hash().alias("content_hash"))
    return x.join(x.groupBy("content_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "content_hash")


KINDS = ("CREATE", "UPDATE", "DELETE")


def sound_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (event_id, path, kind, ts, ...) that can be applied, and the others (event_id, reason): without id, path or
    time, or of an unknown kind. Kinds are taken in any case."""
    kind = F.upper(F.trim("kind"))
    reason = (
        F.when(F.col("event_id").isNull(), "no id").when(F.coalesce(F.trim("path"), F.lit("")) == "", "no path").when(F.col("ts").isNull(), "no time")
        .when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown kind")
    )
    x = events.withColumn("kind", kind).withColumn("reason", reason)
    return x.where("reason is null").drop("reason"), x.where("reason is not null").select("event_id", "reason")


def resolved_deletes(deletes: DataFrame, state: DataFrame) -> DataFrame:
    """(event_id, doc_id, by) for deletes (event_id, source_id, doc_id, uri, path): the document of the state (doc_id,
    source_id, uri, path) that the first of these ways finds: its source_id, its doc_id, its uri, its path whatever the case.

    Where one way finds several documents, the smallest doc_id is taken; deletes that find none are left out.
    """
    ways = [("source_id", F.col("source_id")), ("doc_id", F.col("doc_id")), ("uri", F.col("uri")), ("path", F.lower("path"))]
    key = lambda: F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(n).alias("by"), c.cast("string").alias("value")) for k, (n, c) in enumerate(ways)])).alias("x")
    asked = deletes.select("event_id", key()).select("event_id", "x.*").where("value is not null")
    held = state.select(F.col("doc_id").alias("found"), key()).select("found", F.col("x.rank").alias("rank"), F.col("x.value").alias("value")).where("value is not null")
    hits = asked.join(held.groupBy("rank", "value").agg(F.min("found").alias("found")), ["rank", "value"])
    return hits.groupBy("event_id").agg(F.min(F.struct("rank", "found", "by")).alias("x")).select("event_id", F.col("x.found").alias("doc_id"), "x.by")


def snapshot_then_deltas(snapshot: DataFrame, deltas: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table (key, version, ...) after deltas (the same columns and deleted), whatever part of them the snapshot holds.

    Of a key the row of the highest version counts. So deltas may begin before the snapshot was taken, overlap it and
    repeat, and nothing is lost or applied twice; they must only reach back to the snapshot's moment.
    """
    rest = [c for c in snapshot.columns if c not in (key, "version")]
    x = snapshot.withColumn("deleted", F.lit(False)).unionByName(deltas.select(*snapshot.columns, "deleted"))
    last = x.groupBy(key).agg(F.max(F.struct("version", "deleted", *rest)).alias("x"))
    return last.where("not x.deleted").select(key, "x.version", *[f"x.{c}" for c in rest])
