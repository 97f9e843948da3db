"""The order graphs lie in more partitions where there are more lines, and what follows by graph stays in them."""

import re

import pytest
from pyspark.sql import functions as F

from graphspark import catalog
from graphspark.operators import graphs as g
from graphspark.sources import views

SF = "/root/testdata/sf0.001"


def test_partitions_grow_with_the_lines_and_graphs_stay_whole(spark, monkeypatch):
    want = sorted(map(tuple, g.closure(views.moa_edges(spark, SF)).collect()))
    monkeypatch.setattr(views, "LINES", 500)
    e = views.moa_edges(spark, SF)
    placed = e.select("moa_id", F.spark_partition_id().alias("p")).distinct()
    assert placed.select("p").distinct().count() == 12  # 6,000 lines
    assert placed.groupBy("moa_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, g.closure(e).collect())) == want
    assert g.closure(e).select(F.spark_partition_id().alias("p")).distinct().count() == 12


@pytest.mark.parametrize("name", ["neighbour_type_frequencies", "edges_cum_pct"])
def test_counts_are_the_same_in_many_partitions(spark, monkeypatch, name):
    query = catalog.queries()[name]
    want = sorted(map(tuple, query(spark, SF).collect()))
    monkeypatch.setattr(views, "LINES", 300)
    assert sorted(map(tuple, query(spark, SF).collect())) == want


def test_repeated_edges_are_the_same_edges(spark):
    rows = lambda **p: sorted(map(tuple, views.moa_edges(spark, SF, **p).distinct().collect()))
    assert rows(repeated=True) == rows() == sorted(map(tuple, views.moa_edges(spark, SF).collect()))


@pytest.mark.parametrize("name", ["distance_dilution", "valid_simulatable", "topological_text", "required_types_distance"])
def test_rows_of_graphs_are_dealt_in_many_partitions_after_a_kernel(spark, monkeypatch, name):
    monkeypatch.setattr(views, "LINES", 300)
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for keys, n in re.findall(r"hashpartitioning\(([^)]*), (\d+)\)", plan) if "moa_id" in keys or "orderkey" in keys]
    assert dealt and set(dealt) == {views.order_parts(spark, SF)} and dealt[0] > 4


def test_lines_are_dealt_as_numbers(spark):
    plan = views.moa_edges(spark, SF, repeated=True)._jdf.queryExecution().optimizedPlan()
    found = []

    def walk(node):
        if node.nodeName() == "RepartitionByExpression":
            found.append([(f.name(), f.dataType().typeName()) for f in (node.schema().apply(k) for k in range(node.schema().length()))])
        for k in range(node.children().length()):
            walk(node.children().apply(k))

    walk(plan)
    (lines,) = [x for x in found if "l_orderkey" in dict(x)]
    assert len(lines) == 6 and {kind for _, kind in lines} <= {"long", "integer"}
