import json
import uuid

import pytest
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import chunking, graph, graph_documents

TRIPLES = "doc_id long, chunk_id string, at int, subject string, subject_type string, subject_properties string, predicate string, obj string, obj_type string, obj_properties string, properties string"
CHUNKS = "doc_id long, chunk_id string, index int, text string"
T_ROWS = [
    (1, "c1", 0, "Ann", None, '{"b": 2, "a": {"y": 1, "x": 2}}', "lives in", "Oslo", "City", None, '{"z": 1, "k": [1, 2]}'),
    (1, "c2", 1, "Oslo", "Place", "no json", "part of", "Norway", "Land", "[1]", "{}"),
    (1, None, 2, "Ann", "Person", '{"c": 3}', "knows", " ", None, "", None),
    (2, "c1", 0, "Ann", "Ship", "{}", "sails to", "Oslo", "Port", "{}", "{}"),
]
C_ROWS = [(1, "c1", 0, "First."), (1, "c2", 1, None), (3, "c9", 0, "alone")]


def test_the_first_mention_of_a_document_counts(spark):
    t, c = spark.createDataFrame(T_ROWS, TRIPLES), spark.createDataFrame(C_ROWS, CHUNKS)
    got = {(r.doc_id, r.name): (r.type, r.properties) for r in graph_documents.first_entities(t).collect()}
    assert got == {(1, "Ann"): ("Entity", '{"a":{"x":2,"y":1},"b":2}'), (1, "Oslo"): ("City", "{}"), (1, "Norway"): ("Land", "{}"), (2, "Ann"): ("Ship", "{}"), (2, "Oslo"): ("Port", "{}")}
    docs = {(r.doc_id, r.chunk_id): r for r in graph_documents.graph_documents(t, c).collect()}
    assert {k: (r.text, [e.name for e in r.entities], [(x.source, x.type, x.target) for x in r.relations]) for k, r in docs.items()} == {
        (1, "c1"): ("First.", ["Ann", "Oslo"], [("Ann", "LIVES_IN", "Oslo")]), (1, "c2"): ("", ["Norway", "Oslo"], [("Oslo", "PART_OF", "Norway")]),
        (1, "1"): ("", ["Ann"], [("Ann", "KNOWS", " ")]), (2, "c1"): ("", ["Ann", "Oslo"], [("Ann", "SAILS_TO", "Oslo")]),
    }
    assert docs[1, "c2"].entities[1].type == "City" and docs[1, "c1"].relations[0].properties == '{"k":[1,2],"z":1}'


def test_fingerprints_know_order_of_texts_alone(spark):
    def mark(rows, chunks, n=1):
        return {r.doc_id: r.fingerprint for r in graph_documents.graph_fingerprint(spark.createDataFrame(rows, TRIPLES).repartition(n), spark.createDataFrame(chunks, CHUNKS).repartition(n)).collect()}

    base = mark(T_ROWS, C_ROWS)
    assert set(base) == {1, 2, 3} and base == mark(T_ROWS[::-1], C_ROWS[::-1], 3)
    other_keys = [(*T_ROWS[0][:5], '{ "a":{"x":2,"y":1}, "b":2 }', *T_ROWS[0][6:]), *T_ROWS[1:]]
    assert mark(other_keys, C_ROWS) == base
    other_value = [(*T_ROWS[0][:5], '{"a": 0}', *T_ROWS[0][6:]), *T_ROWS[1:]]
    assert mark(other_value, C_ROWS)[1] != base[1] and mark(other_value, C_ROWS)[2] == base[2]
    swapped = [(1, "c1", 1, "First."), (1, "c2", 0, None), C_ROWS[2]]
    assert mark(T_ROWS, swapped)[1] != base[1]
    assert mark([], []) == {}


def test_property_graph_as_rdf(spark):
    nodes = spark.createDataFrame([("a", "P", '{"n": 1, "o": {"x": [true]}, "": 3, "z": null}'), ("b", None, "oops")], "name string, type string, properties string")
    edges = spark.createDataFrame([("a", "K", "b", '{"since": "now"}'), ("a", "K", "b", None)], "source string, label string, target string, properties string")
    rdf = graph_documents.rdf_view(nodes, edges)
    cut = lambda s: s.replace(graph_documents.BASE, "")
    assert {(cut(r.s), cut(r.p), cut(r.o), r.is_iri) for r in rdf.collect()} == {("a", "rdf:type", "P", True), ("a", "n", "1", False), ("a", "o", '{"x":[true]}', False), ("a", "K", "b", True), ("a", "K_since", "now", False)}
    lines = [json.loads(r.line) for r in graph_documents.json_ld(rdf).collect()]
    base = graph_documents.BASE
    assert lines == [{"@id": base + "a", "rdf:type": [{"@id": base + "P"}], base + "n": [{"@value": "1"}], base + "o": [{"@value": '{"x":[true]}'}], base + "K": [{"@id": base + "b"}], base + "K_since": [{"@value": "now"}]}]


def test_segments_that_reach_the_end_close_their_piece(spark):
    rows = [("v", 0.0, "a"), ("v", 9.0, "b"), ("v", 10.0, "c"), ("v", 35.0, "d"), ("v", 36.0, "e"), ("v", 37.0, " "), ("w", 1.0, None), ("w", None, "x"), ("u", 3.0, "only")]
    got = sorted(tuple(r) for r in chunking.timed(spark.createDataFrame(rows, "id string, start double, text string"), 10).collect())
    assert got == [("u", 0, 0.0, 3.0, "only"), ("v", 0, 0.0, 10.0, "a b c"), ("v", 1, 10.0, 35.0, "d"), ("v", 2, 20.0, 36.0, "e")]


@pytest.mark.parametrize(("name", "want"), [("modified at", "modified_at"), ("a - b!", "a_b"), ("9x", "_9x"), ("?", "_unknown"), (None, "_unknown")])
def test_metadata_key(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(T.metadata_key(F.col("n"))).first()[0] == want


def test_scalars_equal_the_standard_library(spark):
    import posixpath

    paths = ["/a//b/./c", "../x/../../y", "/../a/..", "a/..", "", ".", "//host/x", "///x", "a/b/", "..", "/"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.normal_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == {p: posixpath.normpath(p) if p else "" for p in paths}
    names = ["x", "", "Øl 5", "a" * 300]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5(str(uuid.NAMESPACE_DNS), F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}
    times = ["2024-02-11T04:09:20.34Z", "2024-02-11T05:09:20+01:00", "2024-02-11", "2024-13-01", "now", "", None, "12", "2024"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(T.timestamp(F.col("t")).cast("string").alias("x")).collect()
    assert [r.x for r in got] == ["2024-02-11 04:09:20.34", "2024-02-11 04:09:20", "2024-02-11 00:00:00"] + [None] * 6
    row = spark.createDataFrame([("cat ^ Cat^ kitty ^^DOG^ dog ^pet",)], "r string").select(T.synonyms(F.col("r"), F.lit("Pet")).alias("s")).first()
    assert row.s == ["cat", "kitty", "DOG"]
    urls = [("https://de.wikipedia.org/wiki/Stra%C3%9Fe_1+1", "Straße_1+1", "de"), (" Old Pier ", "Old Pier", "en"), ("", "", "en")]
    got = spark.createDataFrame([(u,) for u, *_ in urls], "u string").select(T.article(F.col("u")).alias("a")).collect()
    assert [(r.a.title, r.a.language) for r in got] == [u[1:] for u in urls]


def test_properties_of_relations_in_three_ways(spark):
    rows = [("A b", "Works For", "http://x/c>d", 7, {"Since": "2001", "doc_id": "9", "n": None}), ("A b", "Works For", "http://x/c>d", None, None), ("A b", "Works For", None, 1, {})]
    r = spark.createDataFrame(rows, "subject string, predicate string, obj string, ref_doc_id long, properties map<string, string>")
    types = spark.createDataFrame([("SINCE", "xsd:gYear")], "name string, datatype string")
    got = lambda mode: {x.line for x in graph.annotated_turtle(r, mode, types).collect()}
    s, p, o, on = "<http://example.org/resource/a_b>", "<http://example.org/ontology#works_for>", "<http://x/c\\u003Ed>", "http://example.org/ontology#"
    assert got("rdf_1.2") == {f'{s} {p} {o} {{| <{on}ref_doc_id> "7" ; <{on}since> "2001"^^xsd:gYear |}} .', f"{s} {p} {o} ."}
    assert got("rdf_star") == {f"{s} {p} {o} .", f'<< {s} {p} {o} >> <{on}ref_doc_id> "7" .', f'<< {s} {p} {o} >> <{on}since> "2001"^^xsd:gYear .'}
    assert got("flat") == {f"{s} {p} {o} .", f'{s} <{on}works_for__since> "2001"^^xsd:gYear .'}
    with pytest.raises(ValueError):
        graph.annotated_turtle(r, "xml")
    assert graph.annotated_turtle(r.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("  I don't know.", True), ("It cannot be Determined here", True), ("I know", False), ("We could not find it", False), ("Not found", True), (None, False), ("", False)])
def test_answers_without_a_result(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.is_no_answer(F.col("t"))).first()[0] is want


def test_files_and_overlap(spark, tmp_path):
    from kgspark.sources.readers import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("abc")
    (tmp_path / "sub" / "b.txt").write_text("ü")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "c.bin").write_text("x")
    got = {r.path.split("/")[-1]: r for r in files(spark, f"file://{tmp_path}", "*.txt").collect()}
    assert {k: (r.size, bytes(r.content)) for k, r in got.items()} == {"a.txt": (3, b"abc"), "b.txt": (2, "ü".encode())}
    assert all(r.fingerprint == f"ord:{r.ordinal}" for r in got.values())
    assert "content" not in files(spark, f"file://{tmp_path}", content=False).columns
    rows = [("a b c", "B c d"), ("x", "x"), ("a a", "a")]
    assert [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(T.word_overlap(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0, 1.0]


def test_names_of_a_triple_are_written_once(spark, tmp_path):
    rows = [("A b", "X", "is in", "C", "Y"), ("a_B", "X", "is in", "c", "Y"), ("A b", "X", "is in", "C", "Y"), (None, None, "of", " ", "Y"), ("D", None, "of", "C", "Y")]
    spark.createDataFrame(rows, "subject string, subject_type string, predicate string, obj string, obj_type string").write.parquet(f"{tmp_path}/t")
    rdf = graph.to_rdf(spark.read.parquet(f"{tmp_path}/t"))
    lines = graph.turtle(rdf)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9_]+") == 5  # a node's type and label, a relation's three parts: not again in filters or branches
    got = [r.line for r in lines.where("section = 1").collect()]
    r, o = graph.BASE, graph.ONTOLOGY
    assert sorted(got) == sorted([
        f"<{r}a_b> rdf:type <{o}X> .", f"<{r}c> rdf:type <{o}Y> .", f'<{r}a_b> rdfs:label "A b" .', f'<{r}a_b> rdfs:label "a_B" .', f'<{r}c> rdfs:label "C" .', f'<{r}c> rdfs:label "c" .', f'<{r}d> rdfs:label "D" .',
        f"<{r}a_b> <{o}is_in> <{r}c> .", f"<{r}entity> <{o}of> <{r}entity> .", f"<{r}d> <{o}of> <{r}c> .",
    ])
    # a pattern's predicate leaves the other parts out
    assert graph.match(rdf, [("?s", o + "is_in", "?o")])._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
