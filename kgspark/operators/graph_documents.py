"""Triples as documents, one for each chunk of text that they come from, and what marks a document's graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "http://example.org/property-graph/"


def canonical_json(c: Column) -> Column:
    """An object as JSON with its keys in order, whatever order and white space it came in; {} for null, other values and what is no JSON."""
    parsed = F.try_parse_json(c)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise(F.lit("{}"))


def primitive_properties(c: Column) -> Column:
    """A JSON object as a map of strings: objects and lists stay as JSON, empty keys go; an empty map for anything else."""
    values = F.from_json(canonical_json(c), "map<string, string>")
    return F.map_filter(F.coalesce(values, F.create_map().cast("map<string, string>")), lambda k, v: k != "")


def _placed(triples: DataFrame) -> DataFrame:
    """triples with the chunk each belongs to: its own, or else its document's id."""
    return triples.withColumn("chunk_id", F.coalesce(F.when(F.trim("chunk_id") != "", F.col("chunk_id")), F.col("doc_id").cast("string")))


def first_entities(triples: DataFrame) -> DataFrame:
    """(doc_id, name, type, properties): of each entity of a document the type and properties of its first mention.

    triples has (doc_id, chunk_id, at, subject, subject_type, subject_properties, predicate, obj, obj_type, obj_properties),
    properties as JSON, at in order of the document's text. The first is the one with the smallest at, subjects before objects;
    of equal ones the smallest type. A missing type is Entity; blank names are none. One aggregate, combined before the shuffle.
    """
    end = lambda side, k: F.struct(F.col(side).alias("name"), F.coalesce(F.col(f"{side}_type"), F.lit("Entity")).alias("type"), canonical_json(F.col(f"{side}_properties")).alias("properties"), F.lit(k).alias("side"))
    x = triples.select("doc_id", "at", F.explode(F.array(end("subject", 0), end("obj", 1))).alias("e")).where("trim(e.name) <> ''")
    first = F.min(F.struct("at", "e.side", "e.type", "e.properties")).alias("x")
    return x.groupBy("doc_id", F.col("e.name").alias("name")).agg(first).select("doc_id", "name", "x.type", "x.properties")


def graph_documents(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, text, entities, relations) for each chunk of a document that has triples.

    chunks is (doc_id, chunk_id, text); a chunk that isn't there, or stands for a whole document, has the empty text.
    entities are (name, type, properties) by name, each as first_entities has it for the whole document; relations (source,
    type, target, properties) by their place in the text. A chunk's triples meet in one row.
    """
    x = _placed(triples)
    known = first_entities(triples)
    named = x.select("doc_id", "chunk_id", F.explode(F.array("subject", "obj")).alias("name")).where("trim(name) <> ''").distinct().join(known, ["doc_id", "name"])
    entities = named.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("name", "type", "properties"))).alias("entities"))
    line = F.struct("at", F.col("subject").alias("source"), F.upper(F.regexp_replace("predicate", " ", "_")).alias("type"), F.col("obj").alias("target"), canonical_json(F.col("properties")).alias("properties"))
    relations = x.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(line)).alias("r"))
    relations = relations.select("doc_id", "chunk_id", F.transform("r", lambda v: F.struct(v["source"].alias("source"), v["type"].alias("type"), v["target"].alias("target"), v["properties"].alias("properties"))).alias("relations"))
    both = relations.join(entities, ["doc_id", "chunk_id"], "left").join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"], "left")
    none = F.array().cast(entities.schema["entities"].dataType)
    return both.select("doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("entities", none).alias("entities"), "relations")


def graph_fingerprint(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of documents with a chunk or a triple: SHA-256 over the SHA-256 of the chunks' texts by
    (index, chunk_id) and of the triples with all their properties by subject, predicate and object.

    The same for any order, partitioning, and order of keys in properties; another if a text moves to another place.
    Units are hashed before they meet, so a document's group holds 64 characters for each.
    """
    text = chunks.select("doc_id", F.lit(0).alias("part"), F.struct(F.col("index").cast("long").alias("index"), F.col("chunk_id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("mark"))
    props = [canonical_json(F.col(c)) for c in ("properties", "subject_properties", "obj_properties")]
    unit = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "predicate", "obj")], *props)), 256)
    line = triples.select("doc_id", F.lit(1).alias("part"), F.struct(F.lit(0).cast("long").alias("index"), F.col("subject").alias("a"), F.col("predicate").alias("b"), F.col("obj").alias("c")).alias("key"), unit.alias("mark"))
    x = text.unionByName(line).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "key", "mark"))).alias("x"))
    return x.select("doc_id", F.sha2(F.array_join(F.transform("x", lambda v: v["mark"]), ""), 256).alias("fingerprint"))


def rdf_view(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(s, p, o, is_iri) of a property graph: nodes (name, type, properties) with their type and each property, relations
    (source, label, target, properties) with a property of theirs at the source as LABEL_property. Properties are JSON."""
    name = lambda c: F.concat(F.lit(BASE), F.col(c))
    row = lambda s, p, o, is_iri: (s.alias("s"), p.alias("p"), o.alias("o"), F.lit(is_iri).alias("is_iri"))
    held = lambda df, *cols: df.select(*cols, F.explode(primitive_properties(F.col("properties"))).alias("prop", "value")).where("value is not null")
    types = nodes.where("type is not null").select(*row(name("name"), F.lit("rdf:type"), name("type"), True))
    own = held(nodes, "name").select(*row(name("name"), name("prop"), F.col("value"), False))
    edges = relations.select(*row(name("source"), name("label"), name("target"), True))
    theirs = held(relations, "source", "label").select(*row(name("source"), F.concat(name("label"), F.lit("_"), "prop"), F.col("value"), False))
    return types.unionByName(own).unionByName(edges).unionByName(theirs).distinct()


def json_ld(rdf: DataFrame) -> DataFrame:
    """(s, line): each subject of (s, p, o, is_iri) as a JSON object with its names under @id and lists of values by predicate."""
    value = F.when(F.col("is_iri"), F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"))))
    lists = rdf.groupBy("s", "p").agg(F.array_sort(F.collect_set(value)).alias("v"))
    key = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    member = F.concat(key(F.col("p")), F.lit(":["), F.array_join("v", ","), F.lit("]"))
    rows = lists.groupBy("s").agg(F.array_sort(F.collect_list(member)).alias("m"))
    return rows.select("s", F.concat(F.lit('{"@id":'), key(F.col("s")), F.lit(","), F.array_join("m", ","), F.lit("}")).alias("line"))
