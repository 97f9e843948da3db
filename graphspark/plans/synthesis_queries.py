"""Queries of graph pairs, new links, samples, and of searches in the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as t
from ..operators import graphs as g, knowledge as kg, synthesis as syn
from ..sources.views import INVERSE, SIGNS, kg_edges, moa_edges, order_parts, table
from .graph_queries import CLOSURE_SQL, EDITABLE_SQL, KG, LEVEL_SQL, MOA, NODE_SQL, RMOA, _editable
from .registry import query

ENDS_SQL = "ends AS (SELECT moa_id, min(node) FILTER (type = 'Customer') AS drug, min(node) FILTER (type = 'Priority') AS disease FROM node GROUP BY 1)"
TARGET_SQL = f"target AS (SELECT DISTINCT moa_id, tail AS protein, relation AS in_relation FROM moa_edge WHERE ttype = 'Part' AND htype IN ('Customer', 'Part') AND relation IN ({', '.join(repr(r) for r in INVERSE)}))"
OUT_SQL = """tgt AS (SELECT DISTINCT target.moa_id AS target_moa, protein, disease AS td FROM target JOIN ends USING (moa_id)),
  outs AS (SELECT t.target_moa, t.protein, s.moa_id AS source_moa FROM tgt t JOIN node n ON n.moa_id = t.target_moa JOIN ends s ON s.drug = n.node WHERE s.disease <> td
    UNION SELECT t.target_moa, t.protein, s.moa_id FROM tgt t JOIN node n ON n.node = t.protein AND n.type = 'Part' JOIN ends s ON s.moa_id = n.moa_id WHERE s.disease <> td)"""


def _ends(e):
    return syn.ends(e, "Customer", "Priority")


def _targets(e):
    return syn.targets(e, "Part", ["Customer", "Part"], INVERSE)


def _packed(spark, d):
    return syn.packed_ends(moa_edges(spark, d, repeated=True), "Customer", "Priority", "Part", ["Customer", "Part"], INVERSE)


@query("graph_ends", f"{MOA}, {NODE_SQL}, {ENDS_SQL} SELECT * FROM ends")
def _(spark, d):
    return _ends(moa_edges(spark, d, repeated=True))


@query("graph_by_id", f"{MOA}, {NODE_SQL}, {ENDS_SQL} SELECT moa_edge.* FROM moa_edge JOIN ends USING (moa_id) WHERE moa_id = 7 OR (drug = 'C:10' AND disease LIKE 'Y:1%')")
def _(spark, d):
    """One graph by its id, and the graphs of a drug and a disease: both conditions hold."""
    e = moa_edges(spark, d)
    asked = _ends(e).where((F.col("moa_id") == 7) | ((F.col("drug") == "C:10") & F.col("disease").startswith("Y:1"))).select("moa_id")
    return e.join(asked, "moa_id", "left_semi")


@query("editable_single_pairs", f"{MOA}, {NODE_SQL}, {ENDS_SQL}, {EDITABLE_SQL}, single AS (SELECT moa_id FROM (SELECT moa_id, count(*) OVER (PARTITION BY drug, disease) AS n FROM ends) WHERE n = 1) SELECT ed.* FROM ed SEMI JOIN single ON ed.moa_id = single.moa_id")
def _(spark, d):
    return _editable(spark, d).join(syn.single_graph_pairs(_ends(moa_edges(spark, d))).select("moa_id"), "moa_id", "left_semi")


@query("factual_samples", f"{MOA}, {NODE_SQL}, {ENDS_SQL}, big AS (SELECT moa_id FROM node GROUP BY 1 HAVING count(DISTINCT node) >= 7) SELECT moa_id, drug, disease FROM (SELECT *, count(*) OVER (PARTITION BY drug, disease) AS n FROM ends) WHERE n = 1 AND moa_id IN (SELECT moa_id FROM big) AND moa_id % 10 <> 3")
def _(spark, d):
    e = moa_edges(spark, d)
    examples = table(spark, d, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("moa_id"))
    return syn.factual_samples(e, _ends(e), examples, 7)


@query("eligible_sources", f"{MOA}, {NODE_SQL}, {ENDS_SQL}, {TARGET_SQL}, {OUT_SQL}, o AS (SELECT target_moa, protein, count(*) AS n FROM outs GROUP BY 1, 2), same AS (SELECT disease, count(*) AS n FROM ends GROUP BY 1) SELECT tgt.target_moa, tgt.protein, (SELECT count(*) FROM ends) - same.n - coalesce(o.n, 0) AS sources FROM tgt JOIN same ON td = disease LEFT JOIN o ON o.target_moa = tgt.target_moa AND o.protein = tgt.protein")
def _(spark, d):
    return syn.eligible_counts(_packed(spark, d), parts=order_parts(spark, d))


INDICATION_SQL = """ind AS (SELECT DISTINCT 'C:' || o_custkey AS drug, 'Y:' || o_orderpriority AS disease FROM orders WHERE o_totalprice > 300000),
  outs_ind AS (SELECT target_moa, protein, source_moa FROM outs UNION SELECT tgt.target_moa, protein, e.moa_id FROM tgt JOIN ind ON ind.disease = tgt.td JOIN ends e ON e.drug = ind.drug WHERE e.disease <> tgt.td)"""


@query("eligible_with_indications", f"{MOA}, {NODE_SQL}, {ENDS_SQL}, {TARGET_SQL}, {OUT_SQL}, {INDICATION_SQL}, o AS (SELECT target_moa, protein, count(*) AS n FROM outs_ind GROUP BY 1, 2), same AS (SELECT disease, count(*) AS n FROM ends GROUP BY 1) SELECT tgt.target_moa, tgt.protein, (SELECT count(*) FROM ends) - same.n - coalesce(o.n, 0) AS sources FROM tgt JOIN same ON td = disease LEFT JOIN o ON o.target_moa = tgt.target_moa AND o.protein = tgt.protein")
def _(spark, d):
    """The same without sources whose drug is known to be indicated for the target's disease."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    known = table(spark, d, "orders").where("o_totalprice > 300000").select(name("C", "o_custkey").alias("drug"), name("Y", "o_orderpriority").alias("disease"))
    return syn.eligible_counts(_packed(spark, d), known, order_parts(spark, d))


SAMPLE_SQL = f"""{TARGET_SQL}, {OUT_SQL}, nxt AS (SELECT o_orderkey AS target_moa, lead(o_orderkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS source_moa FROM orders),
  least_part AS (SELECT moa_id AS source_moa, min(node) AS source_node FROM node WHERE type = 'Part' GROUP BY 1),
  samp AS (SELECT nxt.target_moa, protein, in_relation, nxt.source_moa, source_node FROM target JOIN nxt ON target.moa_id = nxt.target_moa JOIN least_part USING (source_moa)
    JOIN ends a ON a.moa_id = nxt.target_moa JOIN ends b ON b.moa_id = nxt.source_moa
    WHERE a.disease <> b.disease AND NOT EXISTS (SELECT 1 FROM outs o WHERE o.target_moa = nxt.target_moa AND o.protein = target.protein AND o.source_moa = nxt.source_moa)),
  drawn AS (SELECT samp.*, a.level AS source_level, b.level AS target_level, CASE WHEN a.level * b.level = sign THEN in_relation ELSE CASE in_relation {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in INVERSE.items())} END END AS new_relation
    FROM samp JOIN sign ON relation = in_relation JOIN lv a ON a.moa_id = source_moa AND a.node = source_node JOIN lv b ON b.moa_id = target_moa AND b.node = protein WHERE a.level * b.level <> 0)"""


def _samples(spark, d, ways=True):
    """For each target the next order of its day as source, by its least part, where the exclusions allow it; with ``ways`` also the new graphs' edges."""
    parts = order_parts(spark, d)
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate").repartition(parts, "o_orderdate")
    nxt = orders.select(F.col("o_orderkey").alias("target_moa"), F.lead("o_orderkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey")).alias("source_moa"))
    return syn.linked(moa_edges(spark, d, repeated=True), nxt, SIGNS, INVERSE, "Customer", "Priority", "Part", ["Customer", "Part"], parts, ways)


@query("add_link_samples", f"{MOA}, {LEVEL_SQL}, {ENDS_SQL}, {SAMPLE_SQL} SELECT * FROM drawn")
def _(spark, d):
    return _samples(spark, d, ways=False)


@query("add_link_graphs", f"""{RMOA}, {LEVEL_SQL}, {ENDS_SQL}, {SAMPLE_SQL}, {CLOSURE_SQL}, rr AS (SELECT moa_id, head, tail FROM reach UNION SELECT moa_id, node, node FROM node),
  named AS (SELECT *, target_moa || '|' || protein || '|' || in_relation || '|' || source_moa AS name FROM drawn),
  parts AS (SELECT name, source_moa AS moa_id, drug AS a, source_node AS b FROM named JOIN ends ON ends.moa_id = source_moa UNION ALL SELECT name, target_moa, protein, disease FROM named JOIN ends ON ends.moa_id = target_moa),
  ways AS (SELECT name, e.head, e.relation, e.tail FROM parts JOIN moa_edge e USING (moa_id) JOIN rr x ON x.moa_id = e.moa_id AND x.head = a AND x.tail = e.head JOIN rr y ON y.moa_id = e.moa_id AND y.head = e.tail AND y.tail = b
    UNION SELECT name, source_node, new_relation, protein FROM named)
  SELECT name, count(*) AS edges, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails, min(relation) AS least FROM ways GROUP BY 1""")
def _(spark, d):
    ends = lambda c: F.size(F.array_distinct(F.col(f"edges.{c}"))).cast("long")
    name = F.concat_ws("|", "target_moa", "protein", "in_relation", "source_moa").alias("name")
    return _samples(spark, d).select(name, F.size("edges").cast("long").alias("edges"), ends("head").alias("heads"), ends("tail").alias("tails"), F.array_min("edges.relation").alias("least"))


@query("sample_graph_join", f"{MOA}, {NODE_SQL}, {ENDS_SQL} SELECT event_id, user_id AS source_moa_id, moa_id IS NULL AS unknown, drug AS moa_drug, disease AS moa_disease FROM events LEFT JOIN ends ON moa_id = user_id")
def _(spark, d):
    samples = table(spark, d, "events").select("event_id", F.col("user_id").alias("source_moa_id"))
    j = syn.joined_samples(samples, _ends(moa_edges(spark, d)))
    return j.select("event_id", "source_moa_id", F.col("moa_id").isNull().alias("unknown"), "moa_drug", "moa_disease")


@query("sample_positions", f"{MOA}, {NODE_SQL}, {ENDS_SQL}, f AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS ids FROM orders GROUP BY 1), x AS (SELECT o_custkey, unnest(ids) AS moa_id, generate_subscripts(ids, 1) - 1 AS pos FROM f) SELECT o_custkey, pos, x.moa_id, disease FROM x JOIN ends ON ends.moa_id = x.moa_id")
def _(spark, d):
    """Each customer's list of graph ids with its places, joined to the corpus."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("ids"))
    at = o.select("o_custkey", F.posexplode("ids").alias("pos", "x")).select("o_custkey", F.col("pos").cast("long").alias("pos"), F.col("x.o_orderkey").alias("moa_id"))
    return at.join(_ends(moa_edges(spark, d)).select("moa_id", "disease"), "moa_id").select("o_custkey", "pos", "moa_id", "disease")


@query("retyped_nodes", f"{MOA} SELECT DISTINCT moa_id, CASE WHEN htype = 'Nation' THEN 'Place' ELSE htype END AS htype, CASE WHEN htype = 'Nation' THEN 'place ' || head ELSE head END AS head, relation, CASE WHEN ttype = 'Nation' THEN 'place ' || tail ELSE tail END AS tail, CASE WHEN ttype = 'Nation' THEN 'Place' ELSE ttype END AS ttype FROM moa_edge")
def _(spark, d):
    return kg.retyped(moa_edges(spark, d), F.col("type") == "Nation", "Place", F.concat(F.lit("place "), F.col("node")))


@query("common_types", f"{MOA}, {NODE_SQL}, p AS (SELECT o_orderkey AS a_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b_id FROM orders), ty AS (SELECT moa_id, list(DISTINCT type) AS ts FROM node WHERE type <> 'Nation' OR moa_id % 2 = 0 GROUP BY 1) SELECT a_id, b_id, array_to_string(list_sort(list_intersect(x.ts, y.ts)), ',') AS types FROM p JOIN ty x ON x.moa_id = a_id JOIN ty y ON y.moa_id = b_id")
def _(spark, d):
    n = g.nodes_of(moa_edges(spark, d), "moa_id").where("type <> 'Nation' OR moa_id % 2 = 0")
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("a_id"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b_id")).where("b_id IS NOT NULL")
    return kg.common_types(n, n, p).select("a_id", "b_id", F.array_join("types", ",").alias("types"))


@query("qualified_edges", f"{MOA} SELECT moa_id, htype || ': ' || split_part(head, ':', 2) || ' (' || head || ') | ' || relation || ' | ' || ttype || ': ' || split_part(tail, ':', 2) || ' (' || tail || ')' AS text FROM moa_edge")
def _(spark, d):
    node = lambda kind, n: t.qualified_node(F.col(kind), F.split_part(n, F.lit(":"), F.lit(2)), F.col(n))
    return moa_edges(spark, d).select("moa_id", t.edge_text(node("htype", "head"), F.col("relation"), node("ttype", "tail")).alias("text"))


@query("type_transition_any", f"{MOA}, c AS (SELECT coalesce(htype, 'ANY') AS htype, coalesce(ttype, 'ANY') AS ttype, count(*) AS n FROM moa_edge GROUP BY GROUPING SETS ((htype, ttype), (htype), (ttype), ())) SELECT *, round(n / max(n) OVER (PARTITION BY htype), 6) AS p FROM c")
def _(spark, d):
    """P(tail | head), with ANY for either side."""
    c = moa_edges(spark, d).cube("htype", "ttype").agg(F.count("*").alias("n"))
    c = c.select(F.coalesce("htype", F.lit("ANY")).alias("htype"), F.coalesce("ttype", F.lit("ANY")).alias("ttype"), "n")
    return c.withColumn("p", F.round(F.col("n") / F.max("n").over(Window.partitionBy("htype")), 6))


@query("neighbour_type_frequencies", f"{MOA}, nb AS (SELECT DISTINCT moa_id, head AS node, htype AS type, ttype AS other, tail AS o FROM moa_edge UNION SELECT DISTINCT moa_id, tail, ttype, htype, head FROM moa_edge) SELECT type, other, count(DISTINCT (moa_id, node)) AS nodes, count(DISTINCT moa_id) AS graphs, count(DISTINCT node) AS unique_nodes, count(*) AS neighbours FROM nb GROUP BY 1, 2")
def _(spark, d):
    ways = F.array(
        F.struct(F.col("head").alias("node"), F.col("htype").alias("type"), F.col("ttype").alias("other"), F.col("tail").alias("o")),
        F.struct(F.col("tail").alias("node"), F.col("ttype").alias("type"), F.col("htype").alias("other"), F.col("head").alias("o")),
    )
    nb = moa_edges(spark, d).select("moa_id", F.inline(ways)).distinct()
    # by graph first, where its edges are; a graph counts at the first of its nodes
    each = nb.groupBy("moa_id", "type", "other", "node").agg(F.count("*").alias("k"))
    each = each.withColumn("first", F.row_number().over(Window.partitionBy("moa_id", "type", "other").orderBy("node")) == 1)
    nodes = each.groupBy("type", "other", "node").agg(F.count("*").alias("nodes"), F.count_if("first").alias("graphs"), F.sum("k").alias("k"))
    return nodes.groupBy("type", "other").agg(F.sum("nodes").alias("nodes"), F.sum("graphs").alias("graphs"), F.count("node").alias("unique_nodes"), F.sum("k").alias("neighbours"))


@query("drug_report", f"{MOA}, {NODE_SQL}, {ENDS_SQL}, o AS (SELECT drug, ttype, count(DISTINCT (e.moa_id, tail)) AS n FROM ends JOIN moa_edge e ON e.moa_id = ends.moa_id AND e.head = drug GROUP BY 1, 2), p AS (SELECT drug, count(*) AS graphs, count(DISTINCT disease) AS diseases FROM ends GROUP BY 1) SELECT p.*, ttype, n FROM p LEFT JOIN o USING (drug)")
def _(spark, d):
    e = moa_edges(spark, d)
    ends = _ends(e)
    o = e.join(ends.select("moa_id", F.col("drug").alias("head")), ["moa_id", "head"], "left_semi").groupBy(F.col("head").alias("drug"), "ttype").agg(F.count_distinct("moa_id", "tail").alias("n"))
    return ends.groupBy("drug").agg(F.count("*").alias("graphs"), F.count_distinct("disease").alias("diseases")).join(o, "drug", "left")


@query("required_types_distance", f"{RMOA}, {NODE_SQL}, {ENDS_SQL}, {CLOSURE_SQL} SELECT ends.moa_id, distance FROM ends JOIN reach r ON r.moa_id = ends.moa_id AND r.head = drug AND r.tail = disease WHERE distance >= 4 AND (SELECT count(DISTINCT type) FROM node n WHERE n.moa_id = ends.moa_id AND type IN ('Supplier', 'Nation')) = 2")
def _(spark, d):
    e = moa_edges(spark, d, repeated=True)
    among = lambda t: F.bool_or((F.col("htype") == t) | (F.col("ttype") == t))
    has = e.groupBy("moa_id").agg((among("Supplier") & among("Nation")).alias("ok")).where("ok").select("moa_id")
    far = g.end_distances(e, "Customer", "Priority").where("distance >= 4").repartition(order_parts(spark, d), "moa_id")
    return far.join(has, "moa_id", "left_semi").select("moa_id", F.col("distance").cast("long").alias("distance"))


@query("named_shortest_paths", f"{RMOA}, step AS (SELECT DISTINCT moa_id, head, htype, tail FROM moa_edge), w AS (SELECT moa_id, head, tail, [head, tail] AS path FROM step WHERE htype = 'Customer' UNION ALL SELECT w.moa_id, w.head, s.tail, list_append(path, s.tail) FROM w JOIN step s ON w.moa_id = s.moa_id AND w.tail = s.head), b AS (SELECT *, row_number() OVER (PARTITION BY moa_id, head, tail ORDER BY len(path), path) AS k FROM w WHERE tail LIKE 'S:%' OR tail LIKE 'N:%') SELECT moa_id, array_to_string(path, ' > ') AS path FROM b WHERE k = 1")
def _(spark, d):
    p = g.shortest_paths(moa_edges(spark, d, repeated=True), ["Customer"], ["Supplier", "Nation"], least=2)
    return p.select("moa_id", F.array_join("path", " > ").alias("path"))


@query("ordered_set_equality", "WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_name) AS k, n_name FROM nation) SELECT count(*) FILTER (a.n_name = b.n_name) AS same_place, (SELECT count(*) FROM (SELECT n_name FROM a INTERSECT SELECT n_name FROM b)) AS common, bool_and(a.n_name = b.n_name) AS equal_ordered, (SELECT count(*) FROM (SELECT n_name FROM a EXCEPT SELECT n_name FROM b)) = 0 AS equal_sets FROM a JOIN b USING (k)")
def _(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select(F.row_number().over(Window.orderBy(c)).alias("k"), F.col("n_name").alias(x)) for c, x in (("n_nationkey", "a"), ("n_name", "b")))  # 25 rows
    both = a.join(b, "k").agg(F.count_if(F.col("a") == F.col("b")).alias("same_place"), F.bool_and(F.col("a") == F.col("b")).alias("equal_ordered"))
    common = a.select("a").intersect(b.select("b")).agg(F.count("*").alias("common"))
    left = a.select("a").subtract(b.select("b")).agg((F.count("*") == 0).alias("equal_sets"))
    return both.crossJoin(common).crossJoin(left).select("same_place", "common", "equal_ordered", "equal_sets")  # one row each


# --------------------------------------------------------------------------
# The knowledge graph


@query("kg_nodes_of_types", f"{KG} SELECT type, count(*) AS n FROM (SELECT DISTINCT x AS node, xtype AS type FROM kg_edge) WHERE type IN ('Nation', 'Brand') GROUP BY 1")
def _(spark, d):
    return kg.nodes_of_types(kg_edges(spark, d), ["Nation", "Brand"]).groupBy("type").agg(F.count("*").alias("n"))


@query("kg_end_types", f"{KG} SELECT 'head' AS side, xtype AS type, count(DISTINCT x) AS n FROM kg_edge WHERE relation = 'supplier_part' GROUP BY 2 UNION ALL SELECT 'tail', ytype, count(DISTINCT y) FROM kg_edge WHERE relation = 'supplier_part' GROUP BY 2")
def _(spark, d):
    return kg.end_types(kg_edges(spark, d), "supplier_part")


@query("kg_relation_totals", f"{KG} SELECT relation, count(*) AS n FROM kg_edge WHERE relation NOT LIKE 'rev-%' GROUP BY 1")
def _(spark, d):
    return kg.forward(kg_edges(spark, d)).groupBy("relation").agg(F.count("*").alias("n"))


@query("kg_neighbourhood", f"{KG}, w AS (SELECT DISTINCT x AS node, 'out' AS way, relation, y AS other, ytype AS othertype FROM kg_edge WHERE relation NOT LIKE 'rev-%' AND xtype IN ('Nation', 'Supplier') UNION ALL SELECT DISTINCT y, 'in', relation, x, xtype FROM kg_edge WHERE relation NOT LIKE 'rev-%' AND ytype IN ('Nation', 'Supplier')) SELECT node, row_number() OVER (PARTITION BY node ORDER BY way, relation, other) AS n, way, relation, other, othertype FROM w")
def _(spark, d):
    return kg.neighbourhood(kg_edges(spark, d), F.col("type").isin("Nation", "Supplier"))


@query("kg_source_statistics", f"{KG}, n AS (SELECT DISTINCT x AS node, xtype AS type FROM kg_edge) SELECT type, split_part(node, ':', 1) AS source, count(*) AS n FROM n GROUP BY 1, 2")
def _(spark, d):
    return kg.source_statistics(kg_edges(spark, d), F.split_part("node", F.lit(":"), F.lit(1)))


@query("first_seen_index", "WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS pos, 0 AS k, 'P:' || l_partkey AS node FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 1, 'S:' || l_suppkey FROM lineitem), f AS (SELECT node, min((pos, k)) AS first FROM s GROUP BY 1) SELECT node, row_number() OVER (ORDER BY first, node) - 1 AS idx FROM f")
def _(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias(c)
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), name("P:", "l_partkey"), name("S:", "l_suppkey"))
    return kg.first_seen(rows, "at", ["l_partkey", "l_suppkey"])


@query("kg_paths_to_regions", f"{KG}, s AS (SELECT DISTINCT x, y FROM kg_edge WHERE relation NOT LIKE 'rev-%'), one AS (SELECT x, y, [x, y] AS path FROM s WHERE y LIKE 'R:%'), two AS (SELECT s.x, one.y, [s.x, one.x, one.y] AS path FROM s JOIN one ON s.y = one.x) SELECT y AS start, x AS node, len(path) - 1 AS length, array_to_string(path, ' > ') AS path FROM (SELECT * FROM one UNION ALL SELECT * FROM two)")
def _(spark, d):
    """Single-target shortest paths, ordered by their first node and length where they are shown."""
    e = kg.forward(kg_edges(spark, d))
    p = kg.paths_from(e, kg.nodes_of_types(e, ["Region"]).select("node"), most=2, back=True)
    return p.select("start", "node", (F.size("path") - 1).cast("long").alias("length"), F.array_join("path", " > ").alias("path"))


@query("kg_all_shortest_paths", f"{KG}, s AS (SELECT DISTINCT x, y FROM kg_edge WHERE relation IN ('supplier_part', 'part_brand')) SELECT a.x AS start, b.y AS node, count(*) AS paths, min(a.y) AS via FROM s a JOIN s b ON a.y = b.x WHERE a.x LIKE 'S:%' GROUP BY 1, 2")
def _(spark, d):
    e = kg_edges(spark, d).where(F.col("relation").isin("supplier_part", "part_brand"))
    p = kg.paths_from(e, kg.nodes_of_types(e, ["Supplier"]).select("node"), every=True).where("size(path) = 3")
    return p.groupBy("start", "node").agg(F.count("*").alias("paths"), F.min(F.get("path", 1)).alias("via"))


@query("kg_path_texts", f"{KG}, s AS (SELECT DISTINCT x, relation, y FROM kg_forward) SELECT a.x AS start, 2 AS length, a.x || ' -- ' || a.relation || ' --> ' || a.y || ' -- ' || b.relation || ' --> ' || b.y AS text FROM s a JOIN s b ON a.y = b.x WHERE a.relation = 'supplier_nation' AND b.relation = 'nation_region'")
def _(spark, d):
    e = kg.forward(kg_edges(spark, d)).where(F.col("relation").isin("supplier_nation", "nation_region"))
    p = kg.paths_from(e, kg.nodes_of_types(e, ["Supplier"]).select("node")).where("size(path) = 3")
    return kg.path_text(p.select("start", "node", "path"), e, ["start", "node"]).select("start", F.col("length").cast("long").alias("length"), "text")


@query("kg_disease_report", f"{KG}, s AS (SELECT DISTINCT x, y FROM kg_edge WHERE relation IN ('supplier_part', 'part_brand', 'part_type')) SELECT b.y AS disease, a.x AS drug, NULL::VARCHAR AS known, 2 AS length, min([a.x, a.y, b.y])[2] AS via FROM s a JOIN s b ON a.y = b.x WHERE a.x LIKE 'S:%' AND b.y LIKE 'B:%' GROUP BY 1, 2")
def _(spark, d):
    e = kg_edges(spark, d).where(F.col("relation").isin("supplier_part", "part_brand", "part_type"))
    r = kg.disease_report(e, kg.nodes_of_types(e, ["Brand"]).select("node"), "Supplier", ["supplier_brand"])
    return r.select("disease", "drug", "known", F.col("length").cast("long").alias("length"), F.get("path", 1).alias("via"))


@query("compound_term_join", "WITH c AS (SELECT s_suppkey, unnest([lpad(s_nationkey::VARCHAR, 7, '0'), lpad((s_nationkey + 20)::VARCHAR, 7, '0')]) AS part FROM supplier) SELECT s_suppkey, part, n_name FROM c LEFT JOIN nation ON part = lpad(n_nationkey::VARCHAR, 7, '0')")
def _(spark, d):
    ids = table(spark, d, "supplier").select("s_suppkey", F.concat_ws("_", F.col("s_nationkey").cast("string"), (F.col("s_nationkey") + 20).cast("string")).alias("ids"))
    terms = table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 7, F.lit("0")).alias("id"), "n_name")
    found, missing = kg.joined_terms(ids, "s_suppkey", "ids", terms, "id")
    return found.select("s_suppkey", "part", "n_name").unionByName(missing.select("s_suppkey", "part", F.lit(None).cast("string").alias("n_name")))


@query("oriented_pairs", "WITH p AS (SELECT 'N:' || n_nationkey AS child, 'R:' || n_regionkey AS parent FROM nation), q AS (SELECT child AS a, parent AS b FROM p UNION ALL SELECT parent, child FROM p WHERE child LIKE '%1' UNION ALL SELECT child, 'R:x' FROM p) SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM p WHERE child = a AND parent = b) THEN 'child_of' WHEN EXISTS (SELECT 1 FROM p WHERE child = b AND parent = a) THEN 'parent_of' ELSE 'related_to' END AS relation FROM q")
def _(spark, d):
    p = table(spark, d, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R:"), F.col("n_regionkey").cast("string")).alias("parent"))
    q = p.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionAll(p.where("child LIKE '%1'").select("parent", "child")).unionAll(p.select("child", F.lit("R:x")))
    return kg.oriented(q, p)


@query("cross_references", "WITH tm AS (SELECT n_nationkey AS id, ['MESH:' || n_name, 'ICD:' || n_regionkey, 'MESH:D' || n_nationkey] AS xrefs FROM nation) SELECT id, unnest([xrefs[1][6:], xrefs[3][6:]]) AS xref FROM tm")
def _(spark, d):
    x = F.array(F.concat(F.lit("MESH:"), "n_name"), F.concat(F.lit("ICD:"), F.col("n_regionkey").cast("string")), F.concat(F.lit("MESH:D"), F.col("n_nationkey").cast("string")))
    return kg.cross_references(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), x.alias("xrefs")), "MESH:")


@query("both_way_interactions", f"{MOA}, inv(a, b) AS (VALUES {', '.join(str(x) for x in INVERSE.items())}) SELECT DISTINCT head AS x, relation, tail AS y FROM moa_edge UNION SELECT tail, b, head FROM moa_edge JOIN inv ON a = relation")
def _(spark, d):
    e = moa_edges(spark, d).select(F.col("head").alias("x"), "relation", F.col("tail").alias("y"))
    return kg.both_ways(e, INVERSE)
