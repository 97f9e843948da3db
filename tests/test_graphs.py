"""Operators on literal graphs."""

import pytest
from pyspark.sql import functions as F

from graphspark.operators import graphs as g

UP, DOWN = "increases activity of", "decreases activity of"
SIGNS = {UP: 1, DOWN: -1, "causes": 1, "has metabolite": 0}
TYPES = {"D": "Drug", "X": "Disease"}


def edges(spark, *rows):
    full = [("m", h, TYPES.get(h, "Protein"), r, t, TYPES.get(t, "Protein")) for h, r, t in rows]
    return spark.createDataFrame(full, "moa_id string, head string, htype string, relation string, tail string, ttype string")


def levels(spark, *rows):
    return {r.node: r.level for r in g.simulate(edges(spark, *rows), SIGNS, "Drug").collect()}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("D", DOWN, "P"), ("P", "causes", "X")], {"D": 1, "P": -1, "X": -1}),
        ([("D", UP, "A"), ("D", DOWN, "B"), ("A", UP, "X"), ("B", UP, "X")], {"X": 0}),
        ([("D", UP, "P"), ("D", "causes", "P"), ("P", DOWN, "X")], {"P": 1, "X": -1}),
        ([("D", DOWN, "X"), ("E", DOWN, "X")], {"E": 0, "X": -1}),
    ],
)
def test_simulate(spark, rows, want):
    got = levels(spark, *rows)
    assert {k: got[k] for k in want} == want


def test_cut_edges(spark):
    cut = lambda *rows: {(r.head, r.tail) for r in g.cut_edges(edges(spark, *rows), "Drug", "Disease").collect()}
    assert cut(("D", DOWN, "P"), ("P", "causes", "X")) == {("D", "P"), ("P", "X")}
    assert cut(("D", UP, "1"), ("D", UP, "2"), ("1", UP, "3"), ("2", UP, "X"), ("3", UP, "4"), ("4", UP, "X")) == set()


def test_editable_needs_one_relation(spark):
    e = edges(spark, ("D", UP, "P"), ("D", "causes", "P"), ("P", DOWN, "Q"), ("Q", "causes", "X"))
    got = g.editable(e, "Drug", "Disease", {UP: DOWN, DOWN: UP}, ["Drug", "Protein"]).collect()
    assert [(r.head, r.tail, r.new_relation) for r in got] == [("P", "Q", UP)]


def test_closure_of_a_cycle(spark):
    e = edges(spark, ("A", UP, "B"), ("B", UP, "C"), ("C", UP, "A"))
    assert g.closure(e).count() == 9
    start = e.withColumn("htype", F.when(F.col("head") == "A", "Start").otherwise(F.col("htype")))
    start = start.withColumn("ttype", F.when(F.col("tail") == "A", "Start").otherwise(F.col("ttype")))
    assert [tuple(r.path) for r in g.simple_paths(start, "Start").collect()] == [("A", "B", "C")]


def test_bridge(spark):
    e = edges(spark, ("D", "r1", "M"), ("M", "r2", "X"))
    got = [tuple(r)[1:] for r in g.bridge(e, F.col("type") == "Protein").collect()]
    assert got == [("D", "Drug", "r1 :: M :: r2", "X", "Disease")]


def test_unknown_relation_is_not_simulatable(spark):
    assert g.simulatable(edges(spark, ("D", UP, "X")), SIGNS).count() == 1
    assert g.simulatable(edges(spark, ("D", "has metabolite", "P"), ("P", UP, "X")), SIGNS).count() == 0


def test_empty(spark):
    e = edges(spark, ("D", UP, "X")).limit(0)
    for out in (g.closure(e), g.simulate(e, SIGNS, "Drug"), g.cut_edges(e, "Drug", "Disease"), g.topological_order(e), g.shortest_paths(e, ["Drug"]), g.simple_paths(e, "Drug"), g.between(e, "Drug", "Disease"), g.roots_and_sinks(e)):
        assert out.count() == 0


def test_relation_without_a_sign_is_an_error(spark):
    with pytest.raises(Exception, match="without a sign"):
        levels(spark, ("D", "sings to", "P"))


def test_cut_edges_of_a_graph_with_a_cycle(spark):
    e = edges(spark, ("D", UP, "A"), ("A", UP, "B"), ("B", UP, "A"), ("B", UP, "X"))
    assert {(r.head, r.tail) for r in g.cut_edges(e, "Drug", "Disease").collect()} == {("D", "A"), ("A", "B"), ("B", "X")}


def test_long_and_wide_graphs(spark):
    """No bound on depth, and more paths than a long can count."""
    rows, last = [], "D"
    for k in range(90):
        rows += [(last, UP, f"a{k}"), (last, UP, f"b{k}"), (f"a{k}", UP, f"c{k}"), (f"b{k}", UP, f"c{k}")]
        last = f"c{k}"
    e = edges(spark, *rows, (last, DOWN, "X"))
    assert [(r.head, r.tail) for r in g.cut_edges(e, "Drug", "Disease").collect()] == [("c89", "X")]
    assert {r.node: r.level for r in g.simulate(e, SIGNS, "Drug").collect()}["X"] == -1
    assert g.closure(e).where("head = 'D' AND tail = 'X'").first().distance == 181


def test_order_takes_the_least_free_node(spark):
    e = edges(spark, ("b", UP, "c"), ("a", UP, "d"), ("d", UP, "c"), ("z", UP, "a"))
    assert [r.node for r in g.topological_order(e).orderBy("position").collect()] == ["b", "z", "a", "d", "c"]


def test_shortest_paths_name_their_nodes(spark):
    e = edges(spark, ("D", UP, "b"), ("D", UP, "a"), ("a", UP, "X"), ("b", UP, "X"), ("X", UP, "D"))
    got = {tuple(r.path) for r in g.shortest_paths(e, ["Drug"]).collect()}
    assert got == {("D", "a"), ("D", "b"), ("D", "a", "X"), ("D", "a", "X", "D")}
    assert [tuple(r.path) for r in g.shortest_paths(e, ["Drug"], ["Disease"], least=2).collect()] == [("D", "a", "X")]


def test_reduced_graph_passes_dropped_nodes_only(spark):
    e = edges(spark, ("D", UP, "a"), ("a", UP, "b"), ("b", UP, "X"), ("D", UP, "X"), (None, UP, "X"), ("D", UP, "a"))
    assert [(r.head, r.tail) for r in g.reduced_pairs(e, ["Drug", "Disease"]).collect()] == [("D", "X")]
