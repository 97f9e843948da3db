"""Operators on typed graphs. Edges are rows (moa_id, head, htype, relation, tail, ttype); one table holds many graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.views import pick
from .entities import _written
from .kernels import between, closure, cut_edges, end_distances, longest_layers, path_schemata, reduced_pairs, shortest_paths, simple_paths, simulate, topological_order  # noqa: F401


def edge_counts(edges: DataFrame, unique: bool = False) -> DataFrame:
    """Edges by relation and end types; ``unique`` counts equal edges of several graphs once."""
    if unique:
        edges = edges.select("relation", "htype", "head", "ttype", "tail").distinct()
    return edges.groupBy("relation", "htype", "ttype").agg(F.count("*").alias("n"))


def filtered(edges: DataFrame, relation=None, htype=None, ttype=None) -> DataFrame:
    """Rows that equal every given value; a list asks for one of its values."""
    for column, want in (("relation", relation), ("htype", htype), ("ttype", ttype)):
        if want is not None:
            edges = edges.where(F.col(column).isin(want) if isinstance(want, (list, tuple)) else F.col(column) == want)
    return edges


def nodes_of(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys, node, type) of both ends."""
    ends = F.explode(F.array(F.struct(F.col("head").alias("node"), F.col("htype").alias("type")), F.struct(F.col("tail").alias("node"), F.col("ttype").alias("type"))))
    return edges.select(*keys, ends.alias("e")).select(*keys, "e.*").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(moa_id, node, type, n_in, n_out), edges with multiplicity."""
    ends = F.explode(F.array(
        F.struct(F.col("head").alias("node"), F.col("htype").alias("type"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("tail").alias("node"), F.col("ttype").alias("type"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    ))
    return edges.select("moa_id", ends.alias("e")).groupBy("moa_id", "e.node", "e.type").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def roots_and_sinks(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("n_in = 0 OR n_out = 0").select(
        "moa_id", "node", "type", F.when(F.col("n_in") == 0, "root").otherwise("sink").alias("role")
    )


def bridge(edges: DataFrame, dropped: Column) -> DataFrame:
    """Remove nodes whose type fulfils ``dropped`` (an expression of column ``type``), joining each way in with each
    way out; the new relation names both and the node. Where removed nodes follow each other, the way goes on through
    all of them, none twice; a round of the search is a join by graph and node."""
    gone = lambda kind: edges.withColumn("type", F.col(kind)).where(dropped).drop("type")
    kept = edges.withColumn("type", F.col("htype")).where(~dropped).withColumn("type", F.col("ttype")).where(~dropped).drop("type")
    out = gone("htype").select("moa_id", F.col("head").alias("by"), F.col("relation").alias("r"), F.col("tail").alias("to"), F.col("ttype").alias("type")).withColumn("gone", dropped)
    ways = edges.withColumn("type", F.col("ttype")).where(dropped).withColumn("type", F.col("htype")).where(~dropped).drop("type")
    front = ways.select("moa_id", "head", "htype", F.array("relation").alias("label"), "tail", F.array("tail").alias("seen"))
    inner = bool(out.where("gone").limit(1).count())
    while True:
        joined = front.join(out, (front["moa_id"] == out["moa_id"]) & (front["tail"] == out["by"])).select(front["moa_id"], "head", "htype", F.array_append(F.array_append("label", F.col("tail")), F.col("r")).alias("label"), "to", "type", "gone", "seen")
        joined = _written(joined, "ways") if inner else joined
        new = joined.where("NOT gone").select("moa_id", "head", "htype", F.array_join("label", " :: ").alias("relation"), F.col("to").alias("tail"), F.col("type").alias("ttype"))
        kept = kept.unionByName(new)
        front = joined.where("gone AND NOT array_contains(seen, to)").select("moa_id", "head", "htype", "label", F.col("to").alias("tail"), F.array_append("seen", F.col("to")).alias("seen"))
        if not inner or not front.limit(1).count():
            return kept.distinct()


def simulatable(edges: DataFrame, signs: dict[str, int]) -> DataFrame:
    """Graphs all of whose relations have a known sign."""
    return edges.groupBy("moa_id").agg(F.bool_and(F.coalesce(pick(signs, F.col("relation")), F.lit(0)) != 0).alias("ok")).where("ok").select("moa_id")


def editable(edges: DataFrame, root_type: str, sink_type: str, inverse: dict[str, str], types: list[str]) -> DataFrame:
    """Cut edges between given types with exactly one relation, which has an inverse."""
    one = edges.groupBy("moa_id", "head", "tail").agg(F.count("*").alias("n"), F.first("relation").alias("relation")).where("n = 1").drop("n")
    return cut_edges(edges, root_type, sink_type).where(F.col("htype").isin(types) & F.col("ttype").isin(types) & (F.col("ttype") != root_type)).join(
        one.where(F.col("relation").isin(list(inverse))), ["moa_id", "head", "tail"]
    ).select("moa_id", "head", "htype", "relation", "tail", "ttype", pick(inverse, F.col("relation")).alias("new_relation"))


def share(n: str, over: Column | None = None, digits: int = 6) -> Column:
    """n over its sum (within a window's partition)."""
    w = Window.partitionBy() if over is None else Window.partitionBy(over)
    return F.round(F.col(n) / F.sum(n).over(w), digits)
