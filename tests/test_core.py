import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kgspark.functions import text as T
from kgspark.jobs import queries as core
from kgspark.operators import chunking, fusion, graph, metrics, retrieval, sync
from kgspark.streaming import rates

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(round(x, 5)) if isinstance(x, float) else str(x) for x in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_side_effects(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(("name", "want"), [
    ("D:plan.txt", "plan.txt"), ("a\\b/c\\sheet 2.ods", "sheet 2.ods"), ("x//y/", None), ("  ", None), ("", None), (".", None), ("q/..", None), ("a.txt\0", None),
    ("7 notes.v2.tar.gz", "7 notes.v2.tar.gz"), ("größe/übersicht.csv", "übersicht.csv"),
])
def test_safe_filename(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(T.safe_filename(F.col("n"))).first()[0] == want


@pytest.mark.parametrize(("name", "want"), [("Blue  Harbour", "blue_harbour"), ("(7th) Mill & Sons!", "7th_mill_sons"), ("_SHIPS_TO_", "ships_to"), ("?!", "entity"), (None, "entity")])
def test_slug(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(T.slug(F.col("n"))).first()[0] == want


def test_labels(spark):
    df = spark.createDataFrame([("Port / Dock", "ships to"), ("9Lives", "2nd--hand")], "l string, r string").select(T.label(F.col("l")), T.relation_type(F.col("r")))
    assert [tuple(r) for r in df.collect()] == [("Port_Dock", "SHIPS_TO"), ("_9Lives", "_2ND_HAND")]


def test_tidiest_of_equally_frequent_names(spark):
    names = [("old pier", "Old  Pier."), ("old pier", "Old Pier"), ("old pier", "old-pier"), ("", "?"), ("dock", "Dock!"), ("dock", "Dock!"), ("dock", "Docks")]
    got = {tuple(r) for r in graph.canonical_names(spark.createDataFrame(names, "key string, name string")).collect()}
    assert got == {("old pier", "Old Pier", 3), ("dock", "Dock!", 2)}


def test_every_query_row_is_searched(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "node_id long, embedding array<double>")
    got = retrieval.vector_topk_each(v, v.where("node_id > 2").withColumnRenamed("node_id", "query_id"), 2, "l2").collect()
    assert {(r.query_id, r.node_id) for r in got} == {(3, 3), (3, 2), (4, 4), (4, 3), (5, 5), (5, 4)}


def test_chunks_cover_the_text():
    text = "One two. Three four; five: six.\n\nSeven " * 40
    spans = chunking.packed(text, 100, 20)
    assert all(b - a <= 100 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(y[0] <= x[1] < y[1] for x, y in zip(spans, spans[1:], strict=False))
    assert chunking.packed("", 100, 20) == []


def test_pattern_with_repeated_variable(spark):
    rdf = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b")], "s string, p string, o string")
    assert [tuple(r) for r in graph.match(rdf, [("?x", "p", "?x")]).collect()] == [("a",)]


def test_stream_equals_batch(spark, tmp_path):
    events = core._events(spark, FOLDER).where("ts is not null")
    events.write.parquet(str(tmp_path / "in"))
    stream = rates.event_stream(spark, str(tmp_path / "in"), events.schema)
    rates.run_available(rates.rates(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = metrics.window_rates(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.count() > 0 and got.exceptAll(want).count() == 0


def test_patterns_need_a_shared_variable(spark):
    rdf = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("d", "p", "e")], "s string, p string, o string")
    chain = [("?x", "p", "?y"), ("?z", "r", "?w"), ("?y", "q", "?z")]
    assert graph.match(rdf, chain[::2]).select("x", "y", "z").collect() == [("a", "b", "c")]
    assert sorted(graph.match(rdf, [("a", "p", "b"), ("?x", "p", "?y")]).columns) == ["x", "y"]
    assert graph.match(rdf, [("a", "p", "c"), ("?x", "p", "?y")]).count() == 0
    assert graph.match(rdf, chain).count() == 0  # the second pattern waits for the third
    with pytest.raises(ValueError):
        graph.match(rdf, chain[:2])


def test_what_speaks_of_a_document_goes_with_it(spark):
    ref = graph.ONTOLOGY + "ref_doc_id"
    rows = [("x", ref, "7"), ("x", "p", "y"), ("y", "p", "x"), ("_:1", "says", "x"), ("_:1", ref, "2"), ("_:3", ref, "7"), ("_:3", "says", "z"), ("urn:2", "says", "y"), ("z", "says", "x")]
    left = graph.rdf_without_documents(spark.createDataFrame(rows, "s string, p string, o string"), spark.createDataFrame([(7,)], "doc_id long"))
    assert {r.s for r in left.collect()} == {"y", "_:1", "urn:2", "z"}


def test_entities_of_several_documents_stay(spark):
    named = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), (None, "c"), ("1", "c")], "doc_id string, name string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    left = graph.without_documents(n, named, spark.createDataFrame([("1",)], "doc_id string"))
    assert sorted(r.name for r in left.collect()) == ["b", "c", "d"]
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert [(r.source, r.target) for r in graph.without_dangling(e, left).collect()] == [("b", "c")]


def test_updates_right_after_a_creation_are_dropped(spark):
    rows = [(1, "a", "UPDATE", 0.0), (2, "a", "CREATE", 1.0), (3, "a", "UPDATE", 1.5), (4, "a", "UPDATE", 1.9), (5, "a", "UPDATE", 2.0), (6, "b", "UPDATE", 1.2), (7, "a", "CREATE", 2.1)]
    events = spark.createDataFrame(rows, "event_id long, path string, kind string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert sorted(r.event_id for r in sync.burst_collapse(events).collect()) == [1, 2, 5, 6, 7]


def test_results_that_repeat_a_better_one_are_dropped(spark):
    line = " ".join(f"word{i}" for i in range(20))
    rows = [
        (1, 10, 0.9, line, "s"), (1, 10, 0.8, "another text", "s"), (1, 11, 0.7, "Summary: " + line.upper(), "t"), (1, 12, 0.6, line + " more", "s"), (1, 13, 0.5, line + " more", "t"),
        (1, 14, 0.4, line + " a -> b", "u"), (1, 15, 0.3, "short", "s"), (1, 16, 0.2, "Short", "u"), (1, 17, 0.1, None, "u"), (2, 12, 0.6, line + " more", "s"), (2, 18, 0.5, "beyond k", "s"),
    ]
    results = spark.createDataFrame(rows[:-1], "query_id long, node_id long, score double, text string, source string")
    assert {(r.query_id, r.node_id) for r in fusion.greedy_dedup(results).collect()} == {(1, 10), (1, 13), (1, 15), (1, 17), (2, 12)}
    two = spark.createDataFrame(rows[-2:], results.schema)
    assert [r.node_id for r in fusion.greedy_dedup(two, 1).collect()] == [12]


def test_postings_of_replaced_documents(spark):
    docs = spark.createDataFrame([(1, "Red red fish"), (2, "blue; fish"), (3, None)], "node_id long, text string")
    held = retrieval.postings(docs)
    new = retrieval.postings(spark.createDataFrame([(2, "red")], docs.schema))
    now = {(r.term, r.node_id, r.size, r.tf) for r in sync.replace_by_document(held, new, "node_id").collect()}
    assert now == {("red", 1, 3, 2), ("fish", 1, 3, 1), ("red", 2, 1, 1)}


@pytest.mark.parametrize(("text", "want"), [("  KEY facts: a b ", "a b"), ("a. End of text", "a."), ("end of text", ""), ("summary: summary: x", "summary: x"), (None, None)])
def test_core_content(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.core_content(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("name", "want"), [("Up\\Town  \t Hall\n", "Up\\Town Hall"), ("\x00 \x7f", "unknown"), (None, "unknown"), ("Köln #5", "Köln 5")])
def test_node_id(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(T.node_id(F.col("n"), "#")).first()[0] == want


def test_unbound_variables_agree_with_any_value(spark):
    rdf = spark.createDataFrame([("a", "p", "b"), ("a", "q", "c"), ("b", "r", "d"), ("c", "r", "e"), ("f", "q", "c"), ("g", "q", "h")], "s string, p string, o string")
    x = graph.either(graph.match(rdf, [("?x", "p", "?y")]), graph.match(rdf, [("?x", "q", "?z")]))
    assert {f.name for f in x.schema.fields if f.metadata.get("unbound")} == {"y", "z"}
    more = rdf.where("p = 'p' or p = 'q'").select(F.col("s").alias("x"), F.col("o").alias("y"))
    got = sorted(tuple(r) for r in graph.joined(x, more).select("x", "y", "z").fillna("-").collect())
    # (a, b, -) meets (a, b); (a, -, c) meets both of a; (f, -, c) and (g, -, h) meet their own
    assert got == [("a", "b", "-"), ("a", "b", "c"), ("a", "c", "c"), ("f", "c", "c"), ("g", "h", "h")]
    tail = graph.match(rdf, [("?z", "r", "?w"), ("?x", "q", "?z")]).select("x", "z", "w")
    got = sorted(tuple(r) for r in graph.optional(x, tail).select("x", "y", "z", "w").fillna("-").collect())
    assert got == [("a", "-", "c", "e"), ("a", "b", "c", "e"), ("f", "-", "c", "e"), ("g", "-", "h", "-")]
    with pytest.raises(ValueError):
        graph.joined(x.select("z"), graph.either(x.select("z"), x.select("x")))
    with pytest.raises(ValueError):
        graph.joined(x.select("z"), more)


def test_turtle_is_escaped_typed_and_declared(spark):
    rows = [("http://e/a>b c", "rdf:type", "owl:Class", True, None), ("_:n", "http://e/p", 'say "x"\n\\', False, None), ("s:1", "p", "1", False, "xsd:integer"), ("s", "p", "true", False, "xsd:boolean"), ("s", None, "o", True, None)]
    got = [r.line for r in graph.turtle(spark.createDataFrame(rows, "s string, p string, o string, is_iri boolean, datatype string")).where("section = 1").collect()]
    assert got == ['<http://e/a\\u003Eb\\u0020c> rdf:type owl:Class .', '_:n <http://e/p> "say \\"x\\"\\n\\\\" .', '<s:1> <p> "1"^^xsd:integer .', "<s> <p> true ."]


@pytest.mark.parametrize(("name", "want"), [("Łódź Žižek Őű", "odz zizek ou"), ("ﬁne ½ ²", "fine 1 2 2"), ("Ａｂ１", "ab1"), ("𝔘𝔫", "n"), ("e\u0301t\u00e9", "ete"), ("", ""), (None, None)])
def test_keys_are_decomposed(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(T.normalized_key(F.col("n"))).first()[0] == want


def test_pages_with_odd_tags_and_references(spark):
    page = '<p title="x>y" class="a"">&copy;&#8212;&eacute;&#x41;&amp;lt; &bogus; &#0; 1 < 2</p><script>no</script>'
    assert spark.createDataFrame([(page,)], "h string").select(T.html_to_text(F.col("h")).alias("t")).first().t == "©—éA&lt; &bogus; &#0; 1 < 2"


def test_flat_scores_fall_over_all_results(spark):
    rows = [(1, i, 0.5) for i in range(15)] + [(2, 7, 0.3), (3, 1, 0.0), (3, 2, 0.0)]
    got = fusion.ranked(spark.createDataFrame(rows, "query_id long, node_id long, score double"), 10, ["query_id"]).collect()
    assert [r.score for r in sorted((r for r in got if r.query_id == 1), key=lambda r: r.rank)] == [round(1 - i / 14 * 0.8, 3) for i in range(10)]
    assert {(r.query_id, r.node_id, r.score) for r in got if r.query_id > 1} == {(2, 7, 1.0), (3, 1, 0.0), (3, 2, 0.0)}
    one = fusion.ranked(spark.createDataFrame([r[1:] for r in rows[:15]], "node_id long, score double"), 10).collect()
    assert [r.score for r in one][:2] == [1.0, round(1 - 1 / 14 * 0.8, 3)]


def test_noise_of_one_query_does_not_hide_anothers(spark):
    rows = [(1, "g", "A sentence."), (1, "g", "a -> KNOWS -> b"), (2, "g", "a -> KNOWS -> b"), (2, "g", " \t\n"), (2, "h", "Query: MATCH x"), (3, "g", "")]
    got = fusion.without_noise(spark.createDataFrame(rows, "query_id long, retriever string, text string")).collect()
    assert sorted((r.query_id, r.retriever, r.kind) for r in got) == [(1, "g", "content"), (2, "g", "relation"), (2, "h", "step")]


def test_results_without_an_id_are_no_copies(spark):
    rows = [(1, None, 0.9, "first text", "s"), (1, None, 0.8, "second text", "t"), (1, 5, 0.7, "first text", "u"), (1, 5, 0.6, "third text", "v")]
    got = fusion.greedy_dedup(spark.createDataFrame(rows, "query_id long, node_id long, score double, text string, source string")).collect()
    assert sorted(r.score for r in got) == [0.8, 0.9]  # 5 was dropped once and stays known


def test_chunks_are_handed_on_in_parts(spark, monkeypatch):
    """However many texts come in one batch, only chunks of some are held."""
    import pyarrow as pa

    texts = ["One. Two words.\n\n" * 20, None, "", "  ", "x" * 300, "A b. " * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])

    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: list(f(iter([batch])))

    monkeypatch.setattr(chunking, "TOGETHER", 200)
    parts = chunking.chunks(Docs(), 100, 10)
    want = [(i, n, a, b, t[a:b]) for i, t in enumerate(texts) for n, (a, b) in enumerate(s for s in chunking.packed(t or "", 100, 10) if t[s[0] : s[1]].strip())]
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == want
    assert sum(p.num_rows > 0 for p in parts) == 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(tuple(r) for r in chunking.chunks(docs, 100, 10).collect()) == want


def test_neighbours_are_cut_to_the_best_before_they_are_ranked(spark, monkeypatch):
    """However many nodes a hub has, a task hands on the best of each query alone."""
    monkeypatch.setattr(graph, "HELD", 15)
    monkeypatch.setattr(graph, "FEW_SEEDS", 6)  # the seeds are broadcast, what they reach is not
    rows = [("hub", "KNOWS", f"n{i:03d}") for i in range(400)] + [("n001", "LIKES", "hub"), ("n007", "SAW", "far"), ("é", "SAW", "hub"), ("z", "SAW", "z")]
    e = spark.createDataFrame(rows, "source string, label string, target string").repartition(3)
    seeds = spark.createDataFrame([(1, "hub"), (2, "hub"), (2, "n007"), (3, "lost"), (4, "named"), (5, "z"), (6, None)], "query_id int, name string")
    texts = spark.createDataFrame([("n399",), ("n399",), ("named",), ("é",), (None,)], "name string")
    near = {"n399": 1.0, "é": 1.0} | {f"n{i:03d}": 0.6 for i in range(399)}
    first = sorted([("hub", 0.6, 0), *((n, s, 1) for n, s in near.items()), ("far", 0.6, 2)], key=lambda r: (-r[1], r[2], r[0].encode()))[:4]
    second = sorted([("hub", 0.6, 0), ("n007", 0.6, 0), *((n, s, 1) for n, s in near.items() if n != "n007"), ("far", 0.6, 1)], key=lambda r: (-r[1], r[2], r[0].encode()))[:4]
    want = {(1, *r) for r in first} | {(2, *r) for r in second} | {(4, "named", 1.0, 0)}
    got = graph.scored_neighbourhood(e, seeds, texts, 2, 4).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len(graph.scored_neighbourhood(e, seeds, None, 1, 4).collect()) == 8
    x = spark.range(1000).selectExpr("cast(id % 2 as int) as query_id", "string(id) as name", "1D as score", "1 as hop").repartition(2)
    assert x.mapInArrow(lambda it: graph._foremost(it, 3), "query_id int, name string, score double, hop int").count() <= 12
