"""Sources: tables, text and binary files, web pages. Selecting only a file's metadata leaves its content unread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import html_to_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, glob: str = "*", content: bool = True) -> DataFrame:
    """Files below a path on any file system Spark reads: path, modified, ordinal (microseconds), size, fingerprint[, content]. Spark gives no row for empty files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    ordinal = F.unix_micros("modificationTime")
    cols = ["path", F.col("modificationTime").alias("modified"), ordinal.alias("ordinal"), F.col("length").alias("size"), F.concat(F.lit("ord:"), ordinal).alias("fingerprint")]
    return df.select(*cols, *(["content"] if content else []))


def web_documents(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as documents: doc_id, source, text. Pages without text are left out."""
    return pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), html_to_text(F.col("html")).alias("text")).where("text <> ''")


#: A line of N-Triples: subject, predicate, then a name, a blank node or a literal with its language or datatype.
STATEMENT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of N-Triples files below a path: s, p, o, is_iri, lang, datatype. Lines that are none, comments and
    empty ones among them, are left out; numeric escapes stay as they are, others are resolved."""
    part = lambda k: F.regexp_extract("value", STATEMENT, k)
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.col("value").rlike(STATEMENT))
    text = part(5)
    for sign, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(sign), F.lit(char))
    name = F.concat(part(3), part(4))
    none = lambda c: F.when(c != "", c)
    return lines.select(
        F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), F.when(name != "", name).otherwise(text).alias("o"),
        (name != "").alias("is_iri"), none(part(6)).alias("lang"), none(part(7)).alias("datatype"),
    )
