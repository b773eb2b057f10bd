"""A stream of change events applied to a table of documents, each batch once.

The table is kept by version, one for each batch; a batch counts once its row stands in the log, which is written last.
A batch that failed or comes again starts from the version before it, so it leaves the same as if it had run once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from kgspark.operators.sync import sound_events

#: The table: what the last event of each path left. Deleted paths stay, marked, so that late events find them.
STATE = "path string, ts timestamp, event_id long, content string, source_id string, deleted boolean, created timestamp"
LOG = "batch long, applied long, rejected long"


def applied(state: DataFrame, events: DataFrame, seconds: float = 1) -> DataFrame:
    """The state after events (event_id, path, kind CREATE, UPDATE or DELETE, ts, content, source_id).

    Of a path the latest event by (ts, event_id) counts, whichever batch it comes in; an UPDATE less than so many
    seconds after the last CREATE of its path known by then is dropped. An event without source_id leaves the old one.
    Events that repeat have no effect.
    """
    old = state.select("path", "ts", "event_id", "content", "source_id", "deleted", "created", F.lit(True).alias("old"), F.lit("").alias("kind"))
    new = events.select("path", "ts", "event_id", "content", "source_id", (F.col("kind") == "DELETE").alias("deleted"), F.when(F.col("kind") == "CREATE", F.col("ts")).alias("created"), F.lit(False).alias("old"), "kind")
    # the state's row stands where its last CREATE was
    at = F.struct(F.coalesce("created", F.when(F.col("old"), F.lit("0001-01-01").cast("timestamp")).otherwise(F.col("ts"))), ~F.col("old"), "event_id")
    w = W.partitionBy("path").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = old.unionByName(new).withColumn("made", F.last("created", ignorenulls=True).over(w))
    early = (F.col("kind") == "UPDATE") & F.col("made").isNotNull() & (F.unix_micros("ts") - F.unix_micros("made") < int(seconds * 1_000_000))
    x = x.where(~early)
    last = F.struct("ts", "event_id", "content", "deleted")
    got = x.groupBy("path").agg(F.max(last).alias("x"), F.max(F.when(F.col("source_id").isNotNull(), F.struct("ts", "event_id", "source_id"))).alias("s"), F.max("created").alias("created"))
    return got.select("path", "x.ts", "x.event_id", "x.content", "s.source_id", "x.deleted", "created")


class ChangeTable:
    """A table of documents below a path: state/<batch>, log/<batch> and rejected/<batch>."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 1):
        self.spark, self.path, self.seconds = spark, path.rstrip("/"), seconds

    def batches(self) -> list[int]:
        """The batches that count, in order."""
        self.spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{self.path}/log/none")
        rows = self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{self.path}/log")
        return sorted({r.batch for r in rows.select("batch").collect()})

    def state(self, before: int | None = None) -> DataFrame:
        """The rows after the last batch, or after the last one in front of a given one, deleted paths among them."""
        done = [b for b in self.batches() if before is None or b < before]
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state/{done[-1]}") if done else self.spark.createDataFrame([], STATE)

    def documents(self) -> DataFrame:
        """(path, content, source_id, ts) of what is there."""
        return self.state().where("not deleted").select("path", "content", "source_id", "ts")

    def rejected(self) -> DataFrame:
        """Events that were set aside, with what is wrong with them; of batches that count."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], "event_id long, reason string")
        return self.spark.read.parquet(*[f"{self.path}/rejected/{b}" for b in done])

    def apply(self, events: DataFrame, batch: int) -> None:
        """Apply a batch of events; one that counts already is left alone. Events with faults are set aside, the others go on."""
        if batch in self.batches():
            return
        good, bad = sound_events(events)
        bad.write.mode("overwrite").parquet(f"{self.path}/rejected/{batch}")
        applied(self.state(before=batch), good, self.seconds).write.mode("overwrite").parquet(f"{self.path}/state/{batch}")
        counts = self.spark.read.parquet(f"{self.path}/state/{batch}").count(), self.spark.read.parquet(f"{self.path}/rejected/{batch}").count()
        self.spark.createDataFrame([(batch, *counts)], LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{batch}")

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Work through what a stream of events has and stop; the stream's own batch numbers make a repeated batch known."""
        query = events.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
