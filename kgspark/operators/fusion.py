"""Fusing retrievers' results: score scales, sums over copies, flat scores, ranks, filters."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions.text import core_content, is_blank, is_entity_stub, is_query_step, is_relation_line


def labelled(results: dict[str, DataFrame]) -> DataFrame:
    """All results under each other, with the retriever's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("retriever", F.lit(name)) for name, df in results.items()])


def relative_scores(results: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Scores from 0 to 1 within each retriever (and value of by), times 1/n; all 1/n where they are equal."""
    w = W.partitionBy(*(by or []), "retriever")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0) / n)


def reciprocal_ranks(results: DataFrame, n: int, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """Scores 1 / (n (k + rank)), rank within each retriever (and value of by)."""
    rank = F.row_number().over(W.partitionBy(*(by or []), "retriever").orderBy(F.desc("score"), "node_id"))
    return results.withColumn("score", 1 / (n * (k + rank)))


def summed(results: DataFrame, key: str = "node_id", by: list[str] | None = None) -> DataFrame:
    """One row for each node (and value of by) with the sum of its scores."""
    return results.groupBy(*(by or []), key).agg(F.round(F.sum("score"), 6).alias("score"))


def dedup_sum(results: DataFrame) -> DataFrame:
    """One row for each trimmed text: the sum of scores, and the node of the highest (ties: smallest id). Blank texts go."""
    text = results.where("trim(text) <> ''").withColumn("mark", F.sha2(F.trim("text"), 256))
    best = F.max_by("node_id", F.struct("score", (-F.col("node_id")).alias("i")))
    return text.groupBy("mark").agg(F.round(F.sum("score"), 6).alias("score"), best.alias("node_id"), F.count("*").alias("copies"))


def ranked(results: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best with their rank from 1, of all results or of each value of by.

    Where the scores of all results spread under 0.05 and the highest is above 0, scores fall evenly from 1 to 0.2 by
    rank over all of them, so that the k best of more than k end above 0.2; a single result gets 1.
    """
    if by:
        every, order = W.partitionBy(*by), W.partitionBy(*by).orderBy(F.desc("score"), "node_id")
        x = results.withColumn("rank", F.row_number().over(order))
        x = x.withColumn("n", F.count("*").over(every)).withColumn("low", F.min("score").over(every)).withColumn("high", F.max("score").over(every)).where(F.col("rank") <= k)
    else:  # all results are counted by an aggregate; only k of them meet
        range_ = results.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        top = results.orderBy(F.desc("score"), "node_id").limit(k)
        x = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "node_id"))).crossJoin(F.broadcast(range_))
    even = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.round(1 - (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1)) * 0.8, 3))
    return x.withColumn("score", F.when((F.col("high") - F.col("low") < 0.05) & (F.col("high") > 0), even).otherwise(F.col("score"))).drop("n", "low", "high")


def kind_of(t: Column) -> Column:
    """What a result's text is: blank, step (a query or its raw result), relation line, entity stub or content."""
    return F.when(is_blank(t), "blank").when(is_query_step(t), "step").when(is_relation_line(t), "relation").when(is_entity_stub(t), "stub").otherwise("content")


def noise_kinds(results: DataFrame) -> DataFrame:
    """Results with a text and no negative or missing score, each with its kind; a score of 0 is the least of a scale and stays."""
    return results.where("score >= 0").withColumn("kind", kind_of(F.col("text"))).where("kind <> 'blank'")


def content_only(results: DataFrame, steps_of: list[str] | None = None) -> DataFrame:
    """noise_kinds without steps, relation lines and stubs; steps stay for the retrievers in steps_of, which show how they came to a result."""
    kept = F.col("kind") == "content"
    if steps_of:
        kept |= (F.col("kind") == "step") & F.col("retriever").isin(steps_of)
    return noise_kinds(results).where(kept).drop("kind")


def without_noise(results: DataFrame) -> DataFrame:
    """By query_id and retriever, the results of kind content; where there is none, all that are not blank."""
    x = results.withColumn("kind", kind_of(F.col("text"))).where("kind <> 'blank'")
    some = F.max(F.col("kind") == "content").over(W.partitionBy("query_id", "retriever"))
    return x.withColumn("some", some).where((F.col("kind") == "content") | ~F.col("some")).drop("some")


def graph_results(results: DataFrame) -> DataFrame:
    """Of a graph's results by query_id: content with a score above 0 if there is any, else all content, else all that is not blank."""
    x = results.where(~is_blank(F.col("text"))).withColumn("rank", F.when(kind_of(F.col("text")) != "content", 0).when(F.col("score") > 0, 2).otherwise(1))
    return x.withColumn("best", F.max("rank").over(W.partitionBy("query_id"))).where("rank = best").drop("rank", "best")


def greedy_dedup(results: DataFrame, k: int = 15) -> DataFrame:
    """The k best results (query_id, node_id, score, text, source) of each query less those that repeat a better one kept.

    A result repeats another with its node_id, whether that was kept or not, if it has one; with the same first 300 characters of core content in lower case; of the
    same source, where these are over 50 characters and share over 0.7 of their words; or, if it holds '->' and the
    other, of over 50 characters, does not, where their core contents share over 0.6 of their words. As what was kept
    decides, a query's k rows are gone through in order; the rank within a query is cut to k before they meet.
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    top = results.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("core", core_content(F.col("text")))

    def alike(a: str, b: str) -> float:
        x, y = set(a.split()), set(b.split())
        return len(x & y) / len(x | y) if x | y else 0.0

    def first_of_each(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, met = [], set()
        for i, r in pdf.sort_values("rank").iterrows():
            text, core, source = (r[c] or "" for c in ("text", "core", "source"))
            mark, arrow = core[:300].strip().lower(), "->" in text
            node = None if pd.isna(r["node_id"]) else r["node_id"]
            known = node is not None and node in met
            met.add(node)
            if known:
                continue
            for other_mark, other_source, other_core, other_arrow, _ in kept:
                if mark == other_mark:
                    break
                if source == other_source and min(len(mark), len(other_mark)) > 50 and alike(mark, other_mark) > 0.7:
                    break
                if arrow and not other_arrow and len(other_core) > 50 and alike(core, other_core) > 0.6:
                    break
            else:
                kept.append((mark, source, core, arrow, i))
        return pdf.loc[[x[-1] for x in kept], ["query_id", "rank", "node_id", "score"]]

    kinds = dict(top.dtypes)
    return top.groupBy("query_id").applyInPandas(first_of_each, f"query_id {kinds['query_id']}, rank int, node_id {kinds['node_id']}, score {kinds['score']}")
