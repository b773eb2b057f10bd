import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.jobs import queries
from kgspark.operators import graph, resolution, retrieval, vector_index
from kgspark.operators.vector_index import VectorIndex

VECTORS = "node_id long, embedding array<double>"


def recall(found, exact):
    got = {(r.query_id, r.node_id) for r in found.collect()}
    want = {(r.query_id, r.node_id) for r in exact.collect()}
    return len(got & want) / len(want)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_index_of_cells_finds_nine_of_ten(spark, tmp_path, metric):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16)) * 3
    x = centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    x[:400] = x[0]  # a third of all rows is one vector
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(1500, None), (1501, [1.0]), (1502, [0.0] * 16)], VECTORS).repartition(4)
    index = VectorIndex.create(v, f"file://{tmp_path}/index", metric)
    asked = v.where("node_id % 25 = 7").withColumnRenamed("node_id", "query_id")
    exact = retrieval.vector_topk_each(v, asked, 10, metric)
    assert recall(index.search_each(asked), exact) >= 0.9
    cells = spark.read.parquet(f"{index.path}/cells").select("cell").distinct().count()
    assert cells > 5
    about = spark.read.parquet(f"{index.path}/about").first()
    assert about.probes < len(about.centers)
    full = VectorIndex(spark, index.path).search_each(asked, 10, probes=10**6)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, exact.collect()))


def test_index_of_few_or_no_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], VECTORS)
    asked = v.withColumnRenamed("node_id", "query_id")
    assert [tuple(r) for r in VectorIndex.create(v, f"file://{tmp_path}/one").search_each(asked).collect()] == [(1, 1, 1.0)]
    index = VectorIndex.create(v.limit(0), f"file://{tmp_path}/none")
    assert index.search_each(asked).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.create(v, f"file://{tmp_path}/x", "dot")


def test_components_of_chains_and_hubs(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)] + [("x", "x")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(41)}, "hub": "h0", **{f"h{i}": "h0" for i in range(30)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bare_first_names_of_several_people_never_merge(spark):
    names = ["Mira Holm", "Mira Quist", "Mira", "Odd Berg", "Odd", "Odd Berg.", "ODD  BERG", "O'Dell Finn", "O Brant", "?!", None, "Mira Holmm", "Ålesund Verft", "Alesund Verft"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.canonical for r in resolution.resolved(df).collect()}
    assert got["Mira"] == "Mira" and got["Mira Quist"] == "Mira Quist"  # two people share it
    assert got["Mira Holm"] == got["Mira Holmm"]
    assert got["Odd"] == got["Odd Berg"] == got["Odd Berg."] == got["ODD  BERG"] == "Odd Berg"
    assert got["Ålesund Verft"] == got["Alesund Verft"] and got["?!"] == "?!" and None not in got
    first = {r["first"]: r.full_names for r in graph.ambiguous_first_names(df).collect()}
    assert first == {"mira": 3}


def test_resolved_triples(spark):
    rows = [("Kari Nord", "Person", "at", "Nordlys AS", "Company"), ("Kari Nordd", "Person", "at", "Nordlys A.S", "Company"), ("Nordlys AS", "Person", "at", "Kari Nord", "Place"), (None, "Person", "at", "x", None)]
    t = spark.createDataFrame(rows, "subject string, subject_type string, predicate string, obj string, obj_type string")
    got = sorted((str(r.subject), r.obj) for r in resolution.resolve(t, ["Person", "Company"]).collect())
    assert len(got) == 4 and ("None", "x") in got
    assert len({o for s, o in got if s.startswith("Kari")}) == 1 and len({s for s, _ in got if s.startswith("Kari")}) == 1
    assert ("Nordlys AS", "Kari Nord") in got  # a place is not a person


def test_candidates_hold_nine_of_ten_alike_pairs(spark):
    rng = random.Random(4)
    syllables = ["ka", "ri", "no", "ve", "stra", "mol", "pe", "dun", "fi", "gar"]
    names = set()
    while len(names) < 150:
        names.add(" ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(2)))
    names = sorted(names)
    for n in names[:100]:
        i = rng.randrange(len(n))
        names.append(n[:i] + rng.choice("xyz") + n[i + 1 :])
    keys = spark.createDataFrame([(n,) for n in sorted(set(names))], "key string")
    x = keys.alias("x").join(keys.alias("y"), F.col("x.key") < F.col("y.key")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    want = {tuple(r) for r in x.where(resolution.alike(F.col("a"), F.col("b"))).collect()}
    got = {(r.a, r.b) for r in resolution.near_pairs(resolution.letter_vectors(keys)).collect()}
    assert len(want) >= 90 and len(got & want) / len(want) >= 0.9


def test_passes_and_a_least_score_change_no_neighbour(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 12))[rng.integers(0, 6, 400)] + rng.normal(size=(400, 12)) * 0.6
    x[:30] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], VECTORS).repartition(3)
    asked = v.withColumnRenamed("node_id", "query_id")
    index = VectorIndex.create(v, f"file://{tmp_path}/index")
    every = sorted(map(tuple, index.search_each(asked, 7).collect()))
    monkeypatch.setattr(vector_index, "TOGETHER", 90)
    assert sorted(map(tuple, index.search_each(asked, 7).collect())) == every
    some = sorted(map(tuple, index.search_each(asked, 7, least=0.8).collect()))
    assert some == [r for r in every if r[2] >= 0.8] and 0 < len(some) < len(every)
    wrong = spark.createDataFrame([(i, [1.0]) for i in range(200)], "query_id long, embedding array<double>")
    assert index.search_each(wrong).count() == 0


def test_queries_are_found_by_cell_at_once():
    rng = np.random.default_rng(3)
    probed = np.array([rng.permutation(9)[:4] for _ in range(50)], np.int16)
    who, begin = vector_index.asking(probed, 10)
    assert len(begin) == 11
    for c in range(10):
        assert who[begin[c] : begin[c + 1]].tolist() == np.flatnonzero((probed == c).any(1)).tolist()


def test_names_are_the_first_three_words_whatever_stands_between(spark, tmp_path):
    rows = [(4, "12 -- Ann,\n\nÅse's end of all"), (9, "…"), (14, "one"), (19, None), (24, "a1b2c3d4"), (29, "x " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.name for r in queries.spelled_names(spark, str(tmp_path)).collect()} == {4: "Ann Åse s", 14: "one", 24: "a b c", 29: "x x x"}
