"""Knowledge graphs: triples to nodes and edges, counts, neighbourhoods, RDF, patterns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions.text import normalized_key, slug
from kgspark.sources.shared import staged

ONTOLOGY, BASE = "http://example.org/ontology#", "http://example.org/resource/"
#: Parts that the edges of each node are dealt to where many queries meet them.
SPREAD = 8
#: Seeds that may be broadcast, and rows of the best so far that a task holds before it hands them on.
FEW_SEEDS, HELD = 100_000, 100_000
TRIPLE = ["subject", "subject_type", "predicate", "obj", "obj_type"]


def relational_triples(customer: DataFrame, orders: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Foreign keys as typed triples: customer in nation, nation in region, customer placed order."""
    named = lambda c, n: F.concat(F.lit(n + ":"), F.col(c).cast("string"))
    lit = lambda s, n: F.lit(s).alias(n)

    def triples(df: DataFrame, s: str, st: str, p: str, o: str, ot: str) -> DataFrame:
        return df.select(named(s, st).alias("subject"), lit(st, "subject_type"), lit(p, "predicate"), named(o, ot).alias("obj"), lit(ot, "obj_type"))

    x = triples(customer, "c_custkey", "Customer", "located in", "c_nationkey", "Nation")
    x = x.unionByName(triples(nation, "n_nationkey", "Nation", "part of", "n_regionkey", "Region"))
    return x.unionByName(triples(orders, "o_custkey", "Customer", "placed", "o_orderkey", "Order"))


def _either(first: tuple[str, str], second: tuple[str, str], a: str, b: str) -> Column:
    """Two rows (x.a, x.b) of each row: one of the first two columns, one of the second two. Reads its input once, as a union would not."""
    pair = lambda c: F.struct(F.col(c[0]).alias(a), F.col(c[1]).alias(b))
    return F.explode(F.array(pair(first), pair(second))).alias("x")


def nodes(triples: DataFrame) -> DataFrame:
    """(name, type): each end of a triple once, the smallest type where they differ."""
    ends = triples.select(_either(("subject", "subject_type"), ("obj", "obj_type"), "name", "type")).select("x.*")
    return ends.where("trim(name) <> ''").groupBy("name").agg(F.min("type").alias("type"))


def edges(triples: DataFrame) -> DataFrame:
    """(source, label, target), each once; the label is the predicate in upper case with _ for spaces."""
    name = F.upper(F.regexp_replace("predicate", " ", "_"))
    return triples.select(F.col("subject").alias("source"), name.alias("label"), F.col("obj").alias("target")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(name, outgoing, incoming) of every node with an edge."""
    out = e.select(F.col("source").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = out.unionByName(e.select(F.col("target").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("name").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def neighbourhood(e: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(name, hop): nodes within so many undirected steps of the seeds (name), at the fewest. hops is small and fixed."""
    both = e.select(_either(("source", "target"), ("target", "source"), "name", "other")).select("x.*")
    last = seeds.select("name").distinct()
    found = [last.withColumn("hop", F.lit(0))]
    for hop in range(1, hops + 1):
        last = both.join(last, "name", "left_semi").select(F.col("other").alias("name")).distinct()
        found.append(last.withColumn("hop", F.lit(hop)))
    return reduce(DataFrame.unionByName, found).groupBy("name").agg(F.min("hop").alias("hop"))


def _foremost(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows (query_id, name, score, hop) of each query_id among those of a task, or some more: nothing is sorted but a batch and what was best before it."""
    best = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if best is None else pa.concat_tables([best, rows])
        # text in Arrow is ordered by its bytes, as in Spark
        rows = rows.append_column("of", rows.column(0).combine_chunks().dictionary_encode("encode").indices)
        rows = rows.sort_by([("of", "ascending"), ("score", "descending"), ("hop", "ascending"), ("name", "ascending")])
        of = rows.column("of").to_numpy()
        best = rows.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < k)).drop_columns("of")
        if best.num_rows > HELD:
            yield from best.combine_chunks().to_batches()
            best = None
    if best is not None:
        yield from best.combine_chunks().to_batches()


def scored_neighbourhood(e: DataFrame, seeds: DataFrame, texts: DataFrame | None = None, hops: int = 2, k: int = 10) -> DataFrame:
    """(query_id, name, score, hop): the k best nodes within so many steps of each query's seeds (query_id, name), at the fewest.

    Nodes of texts (name) score 1, others 0.6; ties by the fewest steps, then name; seeds are in it themselves, if any edge or
    text has them. Each step is written out, and a node is looked up once for all queries that reached it before: edges
    of a hub are joined by the node's name and one of SPREAD parts.
    """
    both = e.select(_either(("source", "target"), ("target", "source"), "name", "other")).select("x.*").where("name <> other")
    both = staged(both.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(SPREAD))), "both")
    parts = F.explode(F.array(*map(F.lit, range(SPREAD)))).alias("part")
    found = staged(seeds.where("name is not null").select("query_id", "name").distinct().withColumn("hop", F.lit(0)), "reached")
    for hop in range(1, hops + 1):
        last = found.where(F.col("hop") == hop - 1).select("query_id", "name")
        # Spark would broadcast the parts by the size of the file that they are made from
        few = last.limit(FEW_SEEDS + 1).count() <= FEW_SEEDS
        met = both.join(F.broadcast(last), "name") if few else both.join(last.select("*", parts).hint("merge"), ["name", "part"])
        # dealt out before repeats go: a task of a scan would hold all that it reaches at once
        more = met.select("query_id", F.col("other").alias("name")).repartition("query_id", "name").distinct().withColumn("hop", F.lit(hop))
        found = staged(found.unionByName(more.join(found, ["query_id", "name"], "left_anti")), "reached")
    # what a step reached has an edge; of the seeds, those that have one are looked up
    seed = found.where("hop = 0").select("name").distinct()
    few = seed.limit(FEW_SEEDS + 1).count() <= FEW_SEEDS
    tied = both.select("name").join(F.broadcast(seed) if few else seed, "name", "left_semi").distinct()
    plain = found.where("hop > 0").unionByName(found.where("hop = 0").join(tied, "name", "left_semi").select(*found.columns)).withColumn("score", F.lit(0.6))
    x = plain
    if texts is not None:
        named = texts.select("name")
        x = plain.join(named, "name", "left_anti").unionByName(found.join(named, "name", "left_semi").withColumn("score", F.lit(1.0)))
    x = x.select("query_id", "name", F.col("score").cast("double").alias("score"), "hop")
    kinds = ", ".join(f"{c} {t}" for c, t in x.dtypes)
    x = x.mapInArrow(lambda it: _foremost(it, k), kinds)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "hop", "name"))
    return x.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "name", "score", "hop")


def relation_paths(e: DataFrame, keywords: DataFrame, most: int = 40) -> DataFrame:
    """(query_id, label, line): 'a -> LABEL -> b' of the edges that touch a keyword (query_id, keyword), whatever its case,
    the first `most` of each label in order. Keywords go to all tasks; each counts as it stands."""
    word = F.lower("keyword")
    touched = F.contains(F.lower("source"), word) | F.contains(F.lower("target"), word)
    x = e.distinct().join(F.broadcast(keywords.where("keyword <> ''")), touched).select("query_id", "label", F.concat_ws(" -> ", "source", "label", "target").alias("line")).distinct()
    rank = F.row_number().over(W.partitionBy("query_id", "label").orderBy("line"))
    return x.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def valid(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """The triples whose types and predicate the schema (subject_type, predicate, obj_type) allows."""
    return triples.join(schema, ["subject_type", "predicate", "obj_type"], "left_semi").select(*TRIPLE)


def canonical_names(names: DataFrame) -> DataFrame:
    """(key, canonical, spellings): of the spellings (key, name) the most frequent, then tidiest, longest, first. Empty keys go."""
    n = names.where("key <> ''").select("key", F.trim("name").alias("name")).groupBy("key", "name").agg(F.count("*").alias("times"))
    untidy = F.length(F.regexp_replace("name", r"[\p{L}\p{N}\s]", "")) + F.length("name") - F.length(F.trim(F.regexp_replace("name", r"\s+", " ")))  # signs and spare spaces
    w = W.partitionBy("key").orderBy(F.desc("times"), untidy, F.desc(F.length("name")), "name")
    n = n.withColumn("place", F.row_number().over(w)).withColumn("spellings", F.count("*").over(W.partitionBy("key")))
    return n.where("place = 1").select("key", F.col("name").alias("canonical"), "spellings")


def to_rdf(triples: DataFrame) -> DataFrame:
    """(s, p, o, is_iri): type and label of every node, and the relations."""
    iri = lambda c: F.concat(F.lit(BASE), c)
    # a union of literal predicates, so that a pattern's predicate leaves the scans of all others out; no part shares a
    # predicate with another, so each has its own repeats alone, which go while the names are still short
    n = nodes(triples)
    kinds = n.select(slug(F.col("name")).alias("s"), "type").distinct()
    kinds = kinds.select(iri("s").alias("s"), F.lit("rdf:type").alias("p"), F.concat(F.lit(ONTOLOGY), "type").alias("o"), F.lit(True).alias("is_iri"))
    names = n.select(iri(slug(F.col("name"))).alias("s"), F.lit("rdfs:label").alias("p"), F.col("name").alias("o"), F.lit(False).alias("is_iri"))
    e = triples.select(slug(F.col("subject")).alias("s"), slug(F.col("predicate")).alias("p"), slug(F.col("obj")).alias("o")).distinct()
    e = e.select(iri("s").alias("s"), F.concat(F.lit(ONTOLOGY), "p").alias("p"), iri("o").alias("o"), F.lit(True).alias("is_iri"))
    return kinds.unionByName(names).unionByName(e)


def match(rdf: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Solutions of a basic graph pattern: terms that start with ? are variables, joined where they repeat.

    Patterns are taken in an order in which each shares a variable with those before it; if there is none, ValueError.
    A pattern of constants alone keeps the solutions if the triple is there.
    """
    found, todo = None, sorted(patterns, key=lambda p: not any(t.startswith("?") for t in p))
    while todo:
        known = {f"?{c}" for c in found.columns} if found is not None else set()
        pattern = next((p for p in todo if found is None or known & set(p) or not any(t.startswith("?") for t in p)), None)
        if pattern is None:
            raise ValueError(f"no variable is shared with {todo}")
        todo.remove(pattern)
        part, names = rdf, {}
        for col, term in zip("spo", pattern, strict=True):
            if not term.startswith("?"):
                part = part.where(F.col(col) == term)
            elif term[1:] in names:
                part = part.where(F.col(col) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = col
        if not names:
            part = part.select(F.lit(True).alias("_there")).limit(1)
            found = part if found is None else found.crossJoin(F.broadcast(part)).drop("_there")
            continue
        part = part.select(*[F.col(c).alias(n) for n, c in names.items()])
        found = part if found is None else found.join(part, [c for c in part.columns if c in found.columns])
    return found


UNBOUND = {"unbound": True}


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of either pattern; variables that one lacks are unbound there: null, and marked in the schema."""
    loose = set(a.columns) ^ set(b.columns) | _loose(a) | _loose(b)
    return _marked(a.unionByName(b, allowMissingColumns=True), loose)


def _loose(df: DataFrame) -> set[str]:
    """Variables that may be unbound."""
    return {f.name for f in df.schema.fields if f.metadata.get("unbound")}


def _marked(df: DataFrame, loose: set[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata=UNBOUND) if c in loose else F.col(c) for c in df.columns])


def _by_bound(df: DataFrame, loose: list[str]) -> list[tuple[DataFrame, set[str]]]:
    """The solutions parted by which of some variables are unbound."""
    parts = []
    for mask in range(1 << len(loose)):
        gone = {c for k, c in enumerate(loose) if mask >> k & 1}
        part = df
        for c in loose:
            part = part.where(F.col(c).isNull() if c in gone else F.col(c).isNotNull())
        parts.append((part, gone))
    return parts


def joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Solutions of both (inner), or of a with what b adds (left). A variable that is unbound on one side agrees with any
    value, and takes the other's. Each set of bound variables is an equality join of its own; some must remain."""
    shared = [c for c in b.columns if c in a.columns]
    mine, theirs = ([c for c in shared if c in _loose(x)] for x in (a, b))
    if not shared:
        raise ValueError("a part must share a variable")
    if not mine and not theirs:
        return _marked(a.join(b, shared, how), _loose(a) | _loose(b) | (set(b.columns) - set(a.columns) if how == "left" else set()))
    out, cols = [], [*a.columns, *[c for c in b.columns if c not in a.columns]]
    for x, no_x in _by_bound(a, mine):
        rest = x
        for y, no_y in _by_bound(b, theirs):
            keys = [c for c in shared if c not in no_x | no_y]
            if not keys:
                raise ValueError("no variable is bound on both sides")
            also = [c for c in shared if c not in keys]
            z = x.join(y.withColumnsRenamed({c: f"_{c}" for c in also}), keys)
            out.append(z.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in also else F.col(c) for c in cols]))
            rest = rest.join(y, keys, "left_anti") if how == "left" else rest
        if how == "left":
            out.append(rest.select(*[F.col(c) if c in a.columns else F.lit(None).cast(dict(b.dtypes)[c]).alias(c) for c in cols]))
    loose = _loose(a) | _loose(b) if how == "left" else (_loose(a) | _loose(b)) - (set(shared) - set(mine) & set(theirs))
    return _marked(reduce(DataFrame.unionByName, out), loose | (set(b.columns) - set(a.columns) if how == "left" else set()))


def optional(found: DataFrame, more: DataFrame) -> DataFrame:
    """Solutions with what more adds to them, unbound where it has nothing; both share a variable."""
    return joined(found, more, "left")


def one_hop(e: DataFrame, keyword: str, labels: list[str] | None = None) -> DataFrame:
    """(node, direction, label, other): edges out of and into the nodes whose name holds the keyword, whatever its case."""
    e = e.where(F.col("label").isin(labels)) if labels else e
    way = lambda a, b, name: F.struct(F.col(a).alias("node"), F.lit(name).alias("direction"), "label", F.col(b).alias("other"))
    x = e.select(F.explode(F.array(way("source", "target", "out"), way("target", "source", "in"))).alias("x")).select("x.*")
    return x.where(F.contains(F.lower("node"), F.lit(keyword.lower())))


def counts(n: DataFrame, e: DataFrame) -> DataFrame:
    """(kind, label, n): nodes of each type and edges of each label."""
    x = n.groupBy(F.lit("node").alias("kind"), F.col("type").alias("label")).agg(F.count("*").alias("n"))
    return x.unionByName(e.groupBy(F.lit("edge").alias("kind"), "label").agg(F.count("*").alias("n")))


def observed_schema(triples: DataFrame) -> DataFrame:
    """(subject_type, predicate, obj_type, n): what relations stand between what types, to check new triples against."""
    return triples.groupBy("subject_type", "predicate", "obj_type").agg(F.count("*").alias("n"))


def ambiguous_first_names(names: DataFrame) -> DataFrame:
    """(first, full_names): normalized first words that more than one full name of names (name) starts with. These never merge by themselves.

    A full name has two words or more between white space; its first word is normalized by itself, so O'Neil stays one.
    """
    words = F.split(F.trim(F.regexp_replace("name", r"\s+", " ")), " ")
    full = names.where(F.size(words) > 1).select(normalized_key(words[0]).alias("first"), normalized_key(F.col("name")).alias("key"))
    return full.groupBy("first").agg(F.count_distinct("key").alias("full_names")).where("full_names > 1")


def rewritten(triples: DataFrame, names: DataFrame, ends: tuple[str, ...] | list[str] = ("subject", "obj")) -> DataFrame:
    """Triples with their ends renamed by names (name, canonical; each name once); others stay."""
    for end in ends:
        to = names.select(F.col("name").alias(end), F.col("canonical").alias("_to"))
        triples = triples.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return triples


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b) with another node: the smallest node it is linked with over any number of steps.

    Each round ties every node's larger neighbours to its smallest, and then every node to the smallest of those; edges
    never grow in number. Hubs meet in aggregates that combine before the shuffle. Rounds are written out one by one.
    """
    now, last = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"), None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == last:
            small = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            return small.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upper = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = upper.groupBy("u").agg(F.min("v").alias("m"))
        tied = upper.join(lower, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = staged(tied.where("u <> v").distinct(), "links")
    raise RuntimeError("components did not settle")


def mentions(triples: DataFrame) -> DataFrame:
    """(doc_id, name): what entities each document's triples (doc_id, subject, obj) name."""
    x = triples.select("doc_id", F.explode(F.array("subject", "obj")).alias("name"))
    return x.where("trim(name) <> ''").distinct()


def without_documents(n: DataFrame, named: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes left when documents (doc_id) go: all but those that only these mention. Mentions without doc_id count as another document's."""
    others = named.join(gone, "doc_id", "left_anti").select("name").distinct()
    orphans = named.join(gone, "doc_id", "left_semi").select("name").distinct().join(others, "name", "left_anti")
    return n.join(orphans, "name", "left_anti")


def without_dangling(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges of which both ends are there."""
    name = n.select("name").distinct()
    return e.join(name.withColumnRenamed("name", "source"), "source", "left_semi").join(name.withColumnRenamed("name", "target"), "target", "left_semi")


def rdf_without_documents(rdf: DataFrame, gone: DataFrame) -> DataFrame:
    """Triples left when documents (doc_id) go: all triples of the subjects, reifiers among them, that refer to one by
    ref_doc_id themselves. Subjects that only speak of these stay, as do subjects of other documents."""
    refers = rdf.where(F.col("p") == ONTOLOGY + "ref_doc_id").select("s", F.col("o").alias("doc_id"))
    subjects = refers.join(gone.select(F.col("doc_id").cast("string")).distinct(), "doc_id", "left_semi").select("s")
    return rdf.join(subjects, "s", "left_anti")


def annotations(triples: DataFrame, properties: list[str]) -> DataFrame:
    """(subject, predicate, obj, prop, value, datatype): a row for each property of a triple that is not null, with its XSD type."""
    xsd = {"boolean": "xsd:boolean", "tinyint": "xsd:integer", "smallint": "xsd:integer", "int": "xsd:integer", "bigint": "xsd:integer", "float": "xsd:decimal", "double": "xsd:decimal", "date": "xsd:date", "timestamp": "xsd:dateTime"}
    kinds = dict(triples.dtypes)
    each = [F.struct(F.lit(c).alias("prop"), F.col(c).cast("string").alias("value"), F.lit(xsd.get(kinds[c], "xsd:decimal" if kinds[c].startswith("decimal") else "xsd:string")).alias("datatype")) for c in properties]
    x = triples.select("subject", "predicate", "obj", F.explode(F.array(*each)).alias("x")).select("subject", "predicate", "obj", "x.*")
    return x.where("value is not null")


#: Prefixes of the names that to_rdf and annotations write.
PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def iri(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """A name in Turtle: blank nodes and names with a declared prefix stay, others stand in angle brackets with what may not stand there escaped."""
    declared = c.rlike("^(_|" + "|".join(prefixes or PREFIXES) + r"):[A-Za-z0-9_]([A-Za-z0-9_.-]*[A-Za-z0-9_-])?$")
    bad = r"[\x00-\x20<>\"{}|^`\\]"
    safe = lambda x: F.when(x.rlike(bad), F.concat(F.lit("\\u00"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x)
    escaped = F.when(c.rlike(bad), F.array_join(F.transform(F.split(c, ""), safe), "")).otherwise(c)
    return F.when(declared, c).otherwise(F.concat(F.lit("<"), escaped, F.lit(">")))


def literal(value: Column, datatype: Column) -> Column:
    """A literal in Turtle: quoted, with its datatype if that is not null or xsd:string; booleans stand as they are."""
    text = value
    for sign, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(escape))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    typed = F.concat(quoted, F.lit("^^"), iri(datatype))
    return F.when((datatype == "xsd:boolean") & value.isin("true", "false"), value).when(datatype.isNull() | (datatype == "xsd:string"), quoted).otherwise(typed)


def turtle(rdf: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(line): a line that declares each prefix, then each triple (s, p, o, is_iri[, datatype]) as a line of Turtle.

    Lines may be written in any order, as long as the part with the declarations is the first; they carry section 0,
    triples 1. Triples with a null part are left out.
    """
    prefixes = prefixes or PREFIXES
    datatype = F.col("datatype") if "datatype" in rdf.columns else F.lit(None).cast("string")
    o = F.when(F.col("is_iri"), iri(F.col("o"), prefixes)).otherwise(literal(F.col("o"), datatype))
    # asked of the parts: a filter on the lines would write them a second time
    lines = rdf.where("s is not null and p is not null and o is not null").select(F.lit(1).alias("section"), F.concat(iri(F.col("s"), prefixes), F.lit(" "), iri(F.col("p"), prefixes), F.lit(" "), o, F.lit(" .")).alias("line"))
    head = rdf.sparkSession.createDataFrame([(0, f"@prefix {k}: <{v}> .") for k, v in prefixes.items()], "section int, line string")
    return head.unionByName(lines)


# Keys that tell where a relation comes from; they describe documents and are no annotations.
PROVENANCE = ("file_path", "file_name", "file_type", "source", "modified_at", "modified at", "ref_doc_id", "doc_id", "conversion_method")
#: Ways to write properties of a relation: an annotation block, a quoted statement, or a property of the subject.
MODES = ("rdf_1.2", "rdf_star", "flat")
#: Datatypes, by property, that go to every task as one map.
MOST_TYPES = 100_000


def annotated_turtle(relations: DataFrame, mode: str = "rdf_1.2", types: DataFrame | None = None) -> DataFrame:
    """(line): Turtle of relations (subject, predicate, obj, ref_doc_id, properties), names and a map of strings, with their properties.

    rdf_1.2 writes each relation with its ref_doc_id and then its properties as one annotation block; rdf_star the plain
    relation, and a quoted statement with each of them; flat the plain relation, and each property at its subject as
    predicate__property. Plain relations stand once. PROVENANCE and null values are left out. types (name, datatype), by
    upper-case property, gives literals their datatype. Relations with a missing part give no line.
    """
    if mode not in MODES:
        raise ValueError(mode)
    spark = relations.sparkSession
    types = spark.createDataFrame([], "name string, datatype string") if types is None else types
    if types.limit(MOST_TYPES + 1).count() > MOST_TYPES:
        raise ValueError("too many datatypes for one map")
    known = types.where("name is not null").groupBy("name").agg(F.min("datatype").alias("datatype")).agg(F.map_from_entries(F.collect_list(F.struct("name", "datatype"))).alias("types"))
    node = lambda c: F.when(F.col(c).rlike("^(https?|urn):"), F.col(c)).otherwise(F.concat(F.lit(BASE), slug(F.col(c))))
    name = lambda c: F.concat(F.lit(ONTOLOGY), slug(c))
    x = relations.where("subject is not null and predicate is not null and obj is not null").crossJoin(F.broadcast(known))
    own = F.array_sort(F.map_entries(F.map_filter(F.coalesce("properties", F.create_map().cast("map<string, string>")), lambda k, v: v.isNotNull() & ~k.isin(*PROVENANCE))))
    x = x.select(iri(node("subject")).alias("s"), F.col("predicate"), iri(name(F.col("predicate"))).alias("p"), iri(node("obj")).alias("o"), F.col("ref_doc_id").cast("string").alias("ref"), own.alias("own"), "types")
    datatype = lambda k: F.coalesce(F.try_element_at(F.col("types"), F.upper(k)), F.lit("xsd:string"))
    triple = F.concat_ws(" ", "s", "p", "o")
    if mode == "flat":
        flat = lambda e: F.concat_ws(" ", F.col("s"), iri(F.concat(F.lit(ONTOLOGY), slug(F.col("predicate")), F.lit("__"), slug(e["key"]))), literal(e["value"], datatype(e["key"])), F.lit("."))
        lines = F.array_prepend(F.transform("own", flat), F.concat(triple, F.lit(" .")))
        return x.select(F.explode(lines).alias("line")).distinct()
    said = F.transform("own", lambda e: F.concat(iri(name(e["key"])), F.lit(" "), literal(e["value"], datatype(e["key"]))))
    ref = F.concat(iri(F.lit(ONTOLOGY + "ref_doc_id")), F.lit(" "), literal(F.col("ref"), F.lit("xsd:string")))
    said = F.when(F.col("ref").isNotNull(), F.array_prepend(said, ref)).otherwise(said)
    if mode == "rdf_1.2":
        block = F.when(F.size(said) > 0, F.concat(F.lit(" {| "), F.array_join(said, " ; "), F.lit(" |}"))).otherwise("")
        return x.select(F.concat(triple, block, F.lit(" .")).alias("line")).distinct()
    quoted = F.transform(said, lambda v: F.concat(F.lit("<< "), triple, F.lit(" >> "), v, F.lit(" .")))
    return x.select(F.explode(F.array_prepend(quoted, F.concat(triple, F.lit(" .")))).alias("line")).distinct()
