"""Chunkers: documents to rows of slices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of texts whose chunks are held and handed on together, at least one text's.
TOGETHER = 1 << 20
SEPARATORS = (r"\n{2,}", r"[.!?…]\s+", r"[:;]\s+")


def pieces(text: str, size: int, level: int = 0) -> list[tuple[int, int]]:
    """Slices of a text of at most `size` characters: at the separators in turn, at last anywhere."""
    if len(text) <= size:
        return [(0, len(text))] if text else []
    if level == len(SEPARATORS):
        return [(i, min(i + size, len(text))) for i in range(0, len(text), size)]
    out, at = [], 0
    for m in [*re.finditer(SEPARATORS[level], text), None]:
        end = m.end() if m else len(text)
        out += [(at + a, at + b) for a, b in pieces(text[at:end], size, level + 1)]
        at = end
    return out


def packed(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Slices packed to at most `size` characters; each starts with the last pieces before it that fit in `overlap`."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for piece in pieces(text, size):
        if held and piece[1] - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or piece[1] - held[0][0] > size):
                held.pop(0)
        held.append(piece)
    return [*out, (held[0][0], held[-1][1])] if held else out


def chunks(docs: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk_index, start_char, end_char, text) of documents (doc_id, text), in true offsets; blank chunks go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows, held = batch.column(0), batch.column(1), [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                spans = [(a, b) for a, b in packed(text, size, overlap) if text[a:b].strip()]
                rows += [(i, at, a, b, text[a:b]) for at, (a, b) in enumerate(spans)]
                held += len(text)
                if held >= TOGETHER:
                    yield written(ids, rows)
                    rows, held = [], 0
            yield written(ids, rows)

    def written(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        row, *cols = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *map(pa.array, cols, kinds)], ["doc_id", "chunk_index", "start_char", "end_char", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, chunk_index int, start_char int, end_char int, text string")


def sections(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, section, text): a text's parts between matches of a pattern, numbered from 0; blank ones go."""
    return docs.select("doc_id", F.posexplode(F.split("text", pattern)).alias("section", "text")).where("trim(text) <> ''")


def timed(segments: DataFrame, seconds: int = 60) -> DataFrame:
    """(id, chunk, start, end, text) of transcripts (id, start, text), start in seconds: pieces of some so many seconds.

    A segment that reaches the end of the running piece still belongs to it and closes it; the next piece's end is so many
    seconds on, wherever that segment stood. So a piece depends on those before it, and a transcript is gone through in
    order by a fold. The last piece ends where the last segment begins. Blank pieces are left out.
    """
    rows = segments.where("start is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.coalesce("text", F.lit("")).alias("text")))).alias("all"))
    piece = "struct<start: double, end: double, text: string>"
    begin = F.struct(F.lit(float(seconds)).alias("till"), F.lit("").alias("text"), F.array().cast(f"array<{piece}>").alias("done"))

    def step(t: Column, x: Column) -> Column:
        text = F.concat(t["text"], x["text"], F.lit(" "))
        full = F.struct((t["till"] - seconds).alias("start"), x["start"].alias("end"), F.trim(text).alias("text"))
        closed = F.struct((t["till"] + seconds).alias("till"), F.lit("").alias("text"), F.array_append(t["done"], full).alias("done"))
        return F.when(x["start"] >= t["till"], closed).otherwise(F.struct(t["till"].alias("till"), text.alias("text"), t["done"].alias("done")))

    last = lambda t: F.struct((t["till"] - seconds).alias("start"), F.element_at("all", -1)["start"].alias("end"), F.trim(t["text"]).alias("text"))
    folded = rows.withColumn("t", F.aggregate("all", begin, step))
    pieces = F.filter(F.array_append(F.col("t.done"), last(F.col("t"))), lambda v: v["text"] != "")
    return folded.select("id", F.posexplode(pieces).alias("chunk", "x")).select("id", "chunk", "x.start", "x.end", "x.text")
