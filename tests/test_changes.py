import datetime as dt

import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph, metrics, sync
from kgspark.streaming.changes import ChangeTable

EVENTS = "event_id long, path string, kind string, ts timestamp, content string, source_id string"
START = dt.datetime(2024, 1, 1)


def event(i, path, kind, t, content=None, source=None):
    return (i, path, kind, None if t is None else START + dt.timedelta(seconds=t), content or f"c{i}", source)


def held(table):
    return {r.path: (r.content, r.source_id) for r in table.documents().collect()}


def test_changes_count_once_whatever_fails_or_comes_again(spark, tmp_path, monkeypatch):
    table = ChangeTable(spark, f"file://{tmp_path}/t")
    assert held(table) == {} and table.rejected().count() == 0
    one = [event(1, "a", "CREATE", 0, source="s"), event(2, "a", "update", 0.5), event(3, "b", "CREATE", 1), event(4, None, "CREATE", 1), event(5, "x", "move", 2), event(6, "x", "UPDATE", None), event(3, "b", "CREATE", 1)]
    table.apply(spark.createDataFrame(one, EVENTS), 0)
    assert held(table) == {"a": ("c1", "s"), "b": ("c3", None)}  # the update came too soon after the creation
    assert {(r.event_id, r.reason) for r in table.rejected().collect()} == {(4, "no path"), (5, "unknown kind"), (6, "no time")}
    two = spark.createDataFrame([event(7, "a", "UPDATE", 0.9), event(8, "a", "UPDATE", 5), event(9, "b", "DELETE", 6), event(10, "c", "UPDATE", 7)], EVENTS)
    with monkeypatch.context() as m:  # fails after the state was written, before the log
        m.setattr(ChangeTable, "rejected", None)
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.apply(two, 1)
    assert held(table) == {"a": ("c1", "s"), "b": ("c3", None)} and table.batches() == [0]
    for _ in range(2):
        table.apply(two, 1)
        assert held(table) == {"a": ("c8", "s"), "c": ("c10", None)} and table.batches() == [0, 1]
    late = [event(11, "b", "UPDATE", 5.5), event(12, "c", "CREATE", 3, source="z"), event(13, "d", "DELETE", 1)]
    table.apply(spark.createDataFrame(late, EVENTS), 2)
    assert held(table) == {"a": ("c8", "s"), "c": ("c10", "z")}  # older than what is known
    table.apply(spark.createDataFrame([], EVENTS), 3)
    assert held(table) == {"a": ("c8", "s"), "c": ("c10", "z")}


@pytest.mark.parametrize("cut", range(0, 9, 2))
def test_deltas_from_any_point_after_a_snapshot(spark, cut):
    log = [(1, 1, "a", False), (2, 2, "b", False), (1, 3, "c", False), (2, 4, None, True), (3, 5, "d", False), (2, 6, "e", False), (1, 7, None, True), (3, 8, "f", False)]
    rows = spark.createDataFrame(log, "doc_id long, version long, content string, deleted boolean")
    none = rows.limit(0).drop("deleted")
    snapshot = sync.snapshot_then_deltas(none, rows.where(F.col("version") <= cut))
    for begin in (0, cut // 2, cut):
        deltas = rows.where(F.col("version") > begin)
        got = {tuple(r) for r in sync.snapshot_then_deltas(snapshot, deltas.unionByName(deltas)).collect()}
        assert got == {(2, 6, "e"), (3, 8, "f")}


def test_deletes_are_resolved_in_order(spark):
    state = spark.createDataFrame([(1, "s1", "u1", "/A/x"), (2, "s2", "u2", "/b"), (3, "s2", None, "/C")], "doc_id long, source_id string, uri string, path string")
    asked = [(10, "s2", 1, "u1", "/a/X"), (11, "no", 1, "u2", None), (12, None, None, "u2", "/a/x"), (13, None, None, "no", "/c"), (14, None, None, None, None), (15, "1", None, None, None)]
    got = sync.resolved_deletes(spark.createDataFrame(asked, "event_id long, source_id string, doc_id long, uri string, path string"), state)
    assert {tuple(r) for r in got.collect()} == {(10, 2, "source_id"), (11, 1, "doc_id"), (12, 2, "uri"), (13, 3, "path")}


def test_quantiles_inside_buckets(spark):
    rows = [("a", 10, 2), ("a", 20, 6), ("a", None, 8), ("b", 10, 0), ("b", None, 0), ("c", 10, 0), ("c", None, 5), ("d", -5, 3), ("d", 5, 4), ("d", None, 4)]
    b = spark.createDataFrame(rows, "kind string, le long, n long")
    at = lambda q: {r.kind: r.quantile for r in metrics.bucket_quantile(b, q, ["kind"]).collect()}
    assert at(0.5) == {"a": 15.0, "b": None, "c": 10.0, "d": -5.0} and at(0.95)["a"] == 20.0 and at(0.1)["a"] == 4.0


@pytest.mark.parametrize("chunk", ["1 hour", "10 minutes", "1 day"])
def test_counters_that_begin_anew(spark, chunk):
    t = lambda m: START + dt.timedelta(minutes=m)
    rows = [("a", t(0), 5.0), ("a", t(7), 9.0), ("a", t(61), 12.0), ("a", t(70), 2.0), ("a", t(71), 2.0), ("a", t(1439), 4.0), ("a", t(1441), 10.0), ("b", t(3), 1.0), (None, t(1), 1.0), ("a", None, 1.0), ("a", t(5), None)]
    got = {(r.series, r.start): r.increase for r in metrics.increases(spark.createDataFrame(rows, "series string, ts timestamp, value double"), chunk=chunk).collect()}
    assert got == {("a", START): 4.0 + 3 + 2 + 0 + 2, ("a", t(1440)): 6.0, ("b", START): 0.0}
    r = metrics.ratio(spark.createDataFrame([("a", 1), ("c", 3)], "k string, value long"), spark.createDataFrame([("a", 4), ("b", 0), ("c", 0), ("d", 2)], "k string, value long"), ["k"])
    assert {x.k: x.ratio for x in r.collect()} == {"a": 0.25, "b": None, "c": None, "d": 0.0}


def test_neighbours_are_scored_for_many_queries(spark):
    e = spark.createDataFrame([("hub", f"n{i:02}") for i in range(30)] + [("n00", "far"), ("far", "further"), ("x", "x")], "source string, target string").withColumn("label", F.lit("L"))
    seeds = spark.createDataFrame([(1, "hub"), (2, "far"), (2, "n00"), (3, "nowhere"), (4, None), (5, "x")], "query_id long, name string")
    texts = spark.createDataFrame([("n07",), ("further",), ("far",)], "name string")
    got = graph.scored_neighbourhood(e, seeds, texts, hops=2, k=4).collect()
    best = lambda q: [(r.name, r.score, r.hop) for r in sorted(got, key=lambda r: (-r.score, r.hop, r.name)) if r.query_id == q]
    assert best(1) == [("n07", 1.0, 1), ("far", 1.0, 2), ("hub", 0.6, 0), ("n00", 0.6, 1)]
    assert best(2) == [("far", 1.0, 0), ("further", 1.0, 1), ("n07", 1.0, 2), ("n00", 0.6, 0)]
    assert best(3) == best(4) == best(5) == []
    lines = graph.relation_paths(e, spark.createDataFrame([(1, "HUB"), (2, ""), (3, "fur")], "query_id long, keyword string"), 3).collect()
    assert sorted((r.query_id, r.line) for r in lines) == [(1, "hub -> L -> n00"), (1, "hub -> L -> n01"), (1, "hub -> L -> n02"), (3, "far -> L -> further")]
