"""Rates, percentiles and histograms of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Upper ends of the latency buckets, in milliseconds.
BUCKETS = (50, 100, 200, 500, 1000, 2000, 5000, 10000)


def window_rates(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(start, kind, n, total) of events (ts, kind, value) by time window; works on streams too."""
    g = events.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "kind", "n", "total")


def percentiles(events: DataFrame) -> DataFrame:
    """Exact median and 95th percentile of value by kind."""
    return events.groupBy("kind").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def histogram(events: DataFrame, buckets: tuple[int, ...] = BUCKETS) -> DataFrame:
    """(kind, le, n): how many values are at most each bucket's end, cumulative. One pass, one row a kind before the explode."""
    counts = events.groupBy("kind").agg(*[F.count_if(F.col("value") <= b).alias(f"b{b}") for b in buckets])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in buckets]))
    return counts.select("kind", rows.alias("x")).select("kind", "x.*")


def bucket_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, quantile) from cumulative buckets (by, le, n), le null for the one without an end: interpolated inside the
    bucket that holds the q-th of all. The first bucket begins at 0, or ends itself if it does so at or below 0; in the one without
    an end the quantile is the highest end; null for no values. Only a row for each bucket is dealt."""
    w = W.partitionBy(*by).orderBy(F.asc_nulls_last("le"))
    x = buckets.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("start", F.lag("le").over(w))
    x = x.withColumn("wanted", F.max("n").over(W.partitionBy(*by)) * F.lit(float(q))).withColumn("first", F.row_number().over(w) == 1)
    start = F.when(F.col("first") & (F.col("le") > 0), 0.0).otherwise(F.coalesce(F.col("start").cast("double"), F.col("le").cast("double")))
    inside = start + (F.col("le") - start) * F.try_divide(F.col("wanted") - F.col("below"), F.col("n") - F.col("below"))
    x = x.withColumn("value", F.when(F.col("le").isNull(), F.col("start").cast("double")).otherwise(F.coalesce(inside, start)))
    hit = F.when((F.col("n") >= F.col("wanted")) & (F.col("wanted") > 0), F.struct(F.col("le").isNull().alias("open"), "le", "value"))
    return x.groupBy(*by).agg(F.min(hit).alias("x")).select(*by, F.round("x.value", 6).alias("quantile"))


def increases(samples: DataFrame, width: str = "1 day", chunk: str = "1 hour") -> DataFrame:
    """(series, start, increase) of counters (series, ts, value): by how much they rose in each window, a fall being a reset to 0.

    A rise counts where it ends; the first sample of a series begins it. Samples of one moment are taken by value. A
    series is gone through by chunks of time, so that a long one isn't in one task; chunks meet by their ends.
    """
    x = samples.where("series is not null and ts is not null and value is not null").withColumn("chunk", F.window("ts", chunk)["start"]).withColumn("start", F.window("ts", width)["start"])
    own = W.partitionBy("series", "chunk").orderBy("ts", "value")
    was = F.lag("value").over(own)
    risen = lambda now, old: F.when(old.isNull(), 0).when(now >= old, now - old).otherwise(now)
    x = x.withColumn("risen", risen(F.col("value"), was))
    end = F.struct("ts", "value")
    parts = x.groupBy("series", "chunk", "start").agg(F.sum("risen").alias("risen"), F.min(end).alias("first"), F.max(end).alias("last"))
    # a chunk that reaches into two windows has a row for each; its rows are linked inside already
    line = W.partitionBy("series").orderBy("chunk", "start")
    gap = F.when(F.lag("chunk").over(line) == F.col("chunk"), 0).otherwise(risen(F.col("first.value"), F.lag("last.value").over(line)))
    return parts.withColumn("risen", F.col("risen") + gap).groupBy("series", "start").agg(F.round(F.sum("risen"), 4).alias("increase"))


def mean_over_time(samples: DataFrame, width: str = "1 hour") -> DataFrame:
    """(series, start, mean, n) of irregular samples (series, ts, value) by window."""
    g = samples.where("value is not null").groupBy("series", F.window("ts", width)["start"].alias("start"))
    return g.agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def ratio(part: DataFrame, whole: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio) of two values (by, value): null where the whole is 0 or missing, 0 where the part is missing."""
    x = whole.select(*by, F.col("value").alias("whole")).join(part.select(*by, F.col("value").alias("part")), by, "left")
    return x.select(*by, F.round(F.try_divide(F.coalesce("part", F.lit(0)), F.col("whole")), 6).alias("ratio"))
