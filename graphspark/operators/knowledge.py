"""Operators on one large graph: edges are rows (x, xtype, relation, y, ytype); edges back carry the prefix ``rev-``.

Each round of a search is written in the shared folder, so it survives lost executors. Null
nodes match nothing; empty tables give no rows; repeated edges count once unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .entities import _written


def nodes(edges: DataFrame) -> DataFrame:
    """(node, type), distinct."""
    both = F.array(F.struct(F.col("x").alias("node"), F.col("xtype").alias("type")), F.struct(F.col("y").alias("node"), F.col("ytype").alias("type")))
    return edges.select(F.inline(both)).distinct()


def nodes_of_types(edges: DataFrame, types: list[str]) -> DataFrame:
    return nodes(edges).where(F.col("type").isin(types))


def node_table(edges: DataFrame, total: str = "TOTAL") -> DataFrame:
    """(type, n, pct): distinct nodes by type with their share, and a row for all."""
    counts = nodes(edges).groupBy("type").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("n")).select(F.lit(total).alias("type"), "n", F.lit(100.0).alias("pct"))
    share = counts.join(F.broadcast(whole.select(F.col("n").alias("all"))), F.lit(True))  # one row
    return share.select("type", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("pct")).unionByName(whole)


def displayed_counts(edges: DataFrame, display: Column, relation: list[str] | None = None, xtype: str | None = None) -> DataFrame:
    """(relation, display, xtype, ytype, n_rows, n_edges): edge counts with the relation's name for display (an expression), optionally of some relations and one type."""
    rows = edges.withColumn("display", display)
    if relation is not None:
        rows = rows.where(F.col("relation").isin(relation))
    if xtype is not None:
        rows = rows.where(F.col("xtype") == xtype)
    each = rows.groupBy("relation", "display", "xtype", "ytype", "x", "y").agg(F.count("*").alias("k"))
    return each.groupBy("relation", "display", "xtype", "ytype").agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_edges"))


def names_holding(rows: DataFrame, key: str, names: Column, text: str) -> DataFrame:
    """(key, names, first): rows one of whose names holds the text in any case, with the first that does."""
    hit = F.filter(names, lambda x: F.contains(F.lower(x), F.lit(text.lower())))
    return rows.select(key, names.alias("names"), F.get(hit, 0).alias("first")).where("first IS NOT NULL")


def end_types(edges: DataFrame, relation: str) -> DataFrame:
    """(side, type, n): the types at either end of a relation, with the number of distinct nodes."""
    e = edges.where(F.col("relation") == relation)
    sides = F.array(F.struct(F.lit("head").alias("side"), F.col("xtype").alias("type"), F.col("x").alias("node")), F.struct(F.lit("tail").alias("side"), F.col("ytype").alias("type"), F.col("y").alias("node")))
    return e.select(F.inline(sides)).groupBy("side", "type").agg(F.count_distinct("node").alias("n"))


def forward(edges: DataFrame) -> DataFrame:
    """Edges without those that point back."""
    return edges.where(~F.col("relation").startswith("rev-"))


def neighbourhood(edges: DataFrame, of: Column) -> DataFrame:
    """(node, n, way, relation, other, othertype): the numbered neighbours of every node that fulfils ``of`` (an expression of ``node`` and ``type``)."""
    e = forward(edges).distinct()
    ways = F.array(
        F.struct(F.col("x").alias("node"), F.col("xtype").alias("type"), F.lit("out").alias("way"), "relation", F.col("y").alias("other"), F.col("ytype").alias("othertype")),
        F.struct(F.col("y").alias("node"), F.col("ytype").alias("type"), F.lit("in").alias("way"), "relation", F.col("x").alias("other"), F.col("xtype").alias("othertype")),
    )
    order = Window.partitionBy("node").orderBy("way", "relation", "other")
    return e.select(F.inline(ways)).where(of).select("node", F.row_number().over(order).cast("long").alias("n"), "way", "relation", "other", "othertype")


def source_statistics(edges: DataFrame, source: Column) -> DataFrame:
    """(type, source, n): distinct nodes by type and source (an expression of ``node``)."""
    return nodes(edges).groupBy("type", source.alias("source")).agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: row numbers from 1 within each value of ``by``, in the order of columns that tell its rows apart.

    Ranges of a global sort are written and counted, so no task holds all rows of a value; a null is a value of its own.
    """
    part = _written(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = part.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("_by", "_p", F.coalesce(before, F.lit(0)).alias("_base"))  # a row for each range of a value
    inside = part.withColumn("_in", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)))
    joined = inside.join(base, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_base") + F.col("_in")).cast("long").alias(out))


def first_seen(rows: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """(node, idx): nodes numbered from 0 in the order in which they first appear, by ``position`` and then by column.

    Positions are ranked over ranges of a global sort and counts of these ranges, so no task holds all rows.
    """
    seen = F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.col(position).alias("at"), F.lit(k).alias("k")) for k, c in enumerate(columns))))
    first = rows.select(seen).where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("at", "k")).alias("first"))
    part = _written(first.repartitionByRange("first", "node").select("node", "first", F.spark_partition_id().alias("part")), "first-seen")
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("first", "node")) - 1
    return part.withColumn("inside", inside).join(base, "part").select("node", (F.col("base") + F.col("inside")).cast("long").alias("idx"))


def paths_from(edges: DataFrame, start: DataFrame, most: int | None = None, back: bool = False, every: bool = False) -> DataFrame:
    """(start, node, path): shortest paths (arrays of nodes, in the direction of the edges) from every ``node`` of ``start``.

    Of several to one node the least is kept, or, with ``every``, all. ``back`` searches paths that end at the given nodes.
    """
    a, b = ("y", "x") if back else ("x", "y")
    steps = _written(edges.where("x <> y").select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "steps")
    now = start.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    seen, found, far = _written(now, "paths"), None, 0
    front = seen
    while most is None or far < most:
        more = front.join(steps, "node").select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        more = more.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        if not every:
            more = more.groupBy("start", "node").agg(F.min("path").alias("path"))
        front = _written(more, "paths")
        if not front.limit(1).count():
            break
        found = front if found is None else found.unionByName(front)
        seen = _written(seen.select("start", "node").unionByName(front.select("start", "node").distinct()), "seen")
        far += 1
    out = now.limit(0) if found is None else found
    return out.withColumn("path", F.reverse("path")) if back else out


def path_text(paths: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, text): each path as "a -- r1 || r2 --> b -- r3 --> c", relations of one step in order."""
    label = edges.distinct().groupBy("x", "y").agg(F.array_join(F.sort_array(F.collect_set("relation")), " || ").alias("label"))
    pairs = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda u, v: F.struct(u.alias("x"), v.alias("y")))
    steps = paths.select(*keys, "path", F.posexplode(pairs).alias("pos", "e")).select(*keys, "path", "pos", "e.*").join(label, ["x", "y"], "left")
    said = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("-- "), F.coalesce("label", F.lit("?")), F.lit(" --> "), "y").alias("t"))))
    whole = steps.groupBy(*keys, "path").agg(said.alias("said"))
    return whole.select(*keys, (F.size("path") - 1).alias("length"), F.concat_ws(" ", F.get("path", 0), F.array_join(F.transform("said", lambda s: s["t"]), " ")).alias("text"))


def disease_report(edges: DataFrame, diseases: DataFrame, drug_type: str, relations: list[str], most: int | None = None) -> DataFrame:
    """(disease, drug, known, length, path): shortest paths of two edges or more from drugs, not by way of another drug, with the relation that is known for the pair."""
    types = nodes(edges)
    p = paths_from(edges, diseases, most, back=True).withColumnRenamed("start", "disease").where(F.size("path") > 2)
    p = p.join(types.where(F.col("type") == drug_type).select("node"), "node", "left_semi")
    p = p.join(types.where(F.col("type") == drug_type).select(F.col("node").alias("via")), F.get("path", 1) == F.col("via"), "left_anti")
    known = edges.where(F.col("relation").isin(relations)).groupBy(F.col("x").alias("node"), F.col("y").alias("disease")).agg(F.min("relation").alias("known"))
    return p.join(known, ["node", "disease"], "left").select("disease", F.col("node").alias("drug"), "known", (F.size("path") - 1).alias("length"), "path")


def joined_terms(ids: DataFrame, key: str, compound: str, terms: DataFrame, term: str, separator: str = "_", width: int = 7) -> tuple[DataFrame, DataFrame]:
    """(key, part, term columns) of compound ids "A_B_C" against zero-padded term ids, and the (key, part) that no term has."""
    part = F.explode(F.transform(F.split(compound, separator), lambda x: F.lpad(x, width, F.lit("0")))).alias("part")
    each = ids.select(key, part).distinct()
    return each.join(terms, each.part == terms[term]), each.join(terms, each.part == terms[term], "left_anti")


def oriented(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``relation``: child_of or parent_of where ``parents`` (child, parent) knows the two, else related_to."""
    child = parents.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit("child_of").alias("r1")).distinct()
    parent = parents.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit("parent_of").alias("r2")).distinct()
    joined = pairs.join(child, ["a", "b"], "left").join(parent, ["a", "b"], "left")
    return joined.select(*pairs.columns, F.coalesce("r1", "r2", F.lit("related_to")).alias("relation"))


def cross_references(terms: DataFrame, prefix: str) -> DataFrame:
    """(id, xref): a term's cross-references with the prefix, without it."""
    own = F.filter("xrefs", lambda x: x.startswith(prefix))
    return terms.select("id", F.explode(F.transform(own, lambda x: F.replace(x, F.lit(prefix), F.lit("")))).alias("xref"))


def both_ways(interactions: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Interactions (x, relation, y) with a reverse one wherever the relation has an inverse, distinct."""
    from ..sources.views import pick

    back = interactions.select(F.col("y").alias("x"), pick(inverse, F.col("relation")).alias("relation"), F.col("x").alias("y")).where("relation IS NOT NULL")
    return interactions.select("x", "relation", "y").unionByName(back).distinct()


def retyped(edges: DataFrame, node: Column, new_type: str, new_name: Column | None = None) -> DataFrame:
    """Edges (moa_id, head, htype, ..., tail, ttype) where nodes that fulfil ``node`` (an expression of ``node`` and ``type``) get another type, and another name."""
    out = edges
    for end, kind in (("head", "htype"), ("tail", "ttype")):
        there = out.withColumns({"node": F.col(end), "type": F.col(kind)})
        name = F.when(node, new_name).otherwise(F.col(end)) if new_name is not None else F.col(end)
        out = there.withColumns({kind: F.when(node, F.lit(new_type)).otherwise(F.col(kind)), end: name}).drop("node", "type")
    return out.distinct()


def common_types(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, types): the node types that two graphs share; a and b: (moa_id, type), pairs: (a_id, b_id)."""
    sets = lambda df, key: df.groupBy(F.col("moa_id").alias(key)).agg(F.collect_set("type").alias(f"{key}_types"))
    return pairs.join(sets(a, "a_id"), "a_id").join(sets(b, "b_id"), "b_id").select("a_id", "b_id", F.array_sort(F.array_intersect("a_id_types", "b_id_types")).alias("types"))
