"""Ontologies as tables: classes, relations and properties from statements, what may be linked by what, and datatypes.

Statements are rows (s, p, o), of which an object may be a name or a literal. They come from a triples table or, line
by line, from N-Triples files (sources.readers.statements), which Spark splits anywhere between lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies' names, and the type that stands for each kind of datatype.
RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"


def local_name(c: Column) -> Column:
    """The upper-case last part of a name, after # and /."""
    return F.upper(F.regexp_extract(c, r"([^#/]*)$", 1))


def simple_type(c: Column) -> Column:
    """float, int, bool, str (of dates) or string, by what a datatype's name holds; string if there is none."""
    has = lambda *words: c.rlike("|".join(words))
    kind = F.when(has("decimal", "float", "double"), "float").when(has("int"), "int").when(has("boolean"), "bool").when(has("date"), "str")
    return F.coalesce(kind, F.lit("string"))


def _of(rdf: DataFrame, predicate: str, name: str) -> DataFrame:
    return rdf.where(F.col("p") == predicate).select("s", F.col("o").alias(name)).distinct()


def _typed(rdf: DataFrame, kind: str) -> DataFrame:
    return rdf.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + kind)).select("s").distinct()


def classes(rdf: DataFrame) -> DataFrame:
    """(name, uri, description) of the classes; where several have one name, the smallest uri, and the smallest comment on it."""
    x = _typed(rdf, "Class").join(_of(rdf, RDFS + "comment", "description"), "s", "left")
    least = F.min(F.struct(F.col("s").alias("uri"), F.col("description").isNull().alias("none"), "description"))
    return x.groupBy(local_name(F.col("s")).alias("name")).agg(least.alias("x")).select("name", "x.uri", "x.description")


def relations(rdf: DataFrame) -> DataFrame:
    """(name, uri, domain, range) of the object properties, a row for each pair of a domain and a range that are classes, null for others."""
    known = classes(rdf).select("name")
    x = _typed(rdf, "ObjectProperty").join(_of(rdf, RDFS + "domain", "d"), "s", "left").join(_of(rdf, RDFS + "range", "r"), "s", "left")
    x = x.select(local_name(F.col("s")).alias("name"), F.col("s").alias("uri"), local_name(F.col("d")).alias("d"), local_name(F.col("r")).alias("r"))
    x = x.join(known.withColumnRenamed("name", "domain"), F.col("d") == F.col("domain"), "left")
    return x.join(known.withColumnRenamed("name", "range"), F.col("r") == F.col("range"), "left").select("name", "uri", "domain", "range").distinct()


def properties(rdf: DataFrame) -> DataFrame:
    """(owner, owner_kind, name, type, datatype) of the datatype properties: of the entity its domain names or, where
    no class has that name, of the relation; owner and kind are null if neither is known. datatype is xsd:string if no range is given."""
    x = _typed(rdf, "DatatypeProperty").join(_of(rdf, RDFS + "domain", "d"), "s", "left").join(_of(rdf, RDFS + "range", "range"), "s", "left")
    x = x.select(local_name(F.col("s")).alias("name"), local_name(F.col("d")).alias("d"), "range")
    owners = classes(rdf).select(F.col("name").alias("owner"), F.lit(0).alias("order")).unionByName(relations(rdf).select(F.col("name").alias("owner"), F.lit(1).alias("order")).distinct())
    owners = owners.groupBy("owner").agg(F.min("order").alias("order"))  # a class before a relation of its name
    x = x.join(owners, F.col("d") == F.col("owner"), "left")
    kind = F.when(F.col("order") == 0, "entity").when(F.col("order") == 1, "relation")
    return x.select("owner", kind.alias("owner_kind"), "name", simple_type(F.col("range")).alias("type"), F.coalesce("range", F.lit(XSD + "string")).alias("datatype")).distinct()


def validation_schema(rdf: DataFrame) -> DataFrame:
    """(subject_type, predicate, obj_type) that the relations allow: their domain and range; any class where only a domain
    is given; nothing for relations without a domain. Each once."""
    rel = relations(rdf).where("domain is not null")
    both = rel.where("range is not null").select(F.col("domain").alias("subject_type"), F.col("name").alias("predicate"), F.col("range").alias("obj_type"))
    # by name: a relation with a range in any row is not open
    open_ = rel.where("range is null").select(F.col("domain").alias("subject_type"), F.col("name").alias("predicate"), F.lit(1).alias("one")).distinct()
    every = classes(rdf).select(F.col("name").alias("obj_type"), F.lit(1).alias("one"))
    return both.unionByName(open_.join(every, "one").drop("one")).distinct()


def xsd_types(rdf: DataFrame) -> DataFrame:
    """(name, datatype) of every datatype property: the smallest of its ranges, xsd:string if there is none."""
    return properties(rdf).groupBy("name").agg(F.min("datatype").alias("datatype"))


def typed_literals(values: DataFrame, types: DataFrame) -> DataFrame:
    """values (s, prop, value) with the datatype that the ontology declares for prop, whatever its case; xsd:string if it declares none."""
    x = values.withColumn("name", F.upper("prop")).join(types, "name", "left")
    return x.select("s", "prop", "value", F.coalesce("datatype", F.lit(XSD + "string")).alias("datatype"))


def uris(rdf: DataFrame) -> DataFrame:
    """(name, uri) of classes, relations and datatype properties; of one name a datatype property's, else a relation's."""
    kinds = classes(rdf).select("name", "uri", F.lit(0).alias("order")).unionByName(relations(rdf).select("name", "uri", F.lit(1).alias("order")))
    props = _typed(rdf, "DatatypeProperty").select(local_name(F.col("s")).alias("name"), F.col("s").alias("uri"), F.lit(2).alias("order"))
    return kinds.unionByName(props).groupBy("name").agg(F.max_by("uri", F.struct("order", "uri")).alias("uri"))
