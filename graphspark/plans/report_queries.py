"""Queries of reports and look-ups over the knowledge graph and its names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import entities, knowledge as kg
from ..sources.views import KG_SQL, kg_edges, pick, table
from .registry import query

KG = f"WITH {KG_SQL}"
# What relations are called in reports.
DISPLAY = {"supplier_part": "supplies", "supplier_nation": "located in", "customer_nation": "lives in", "nation_region": "part of", "part_brand": "of brand", "part_type": "of type"}
DISPLAY_SQL = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items()) + " ELSE relation END"


@query("kg_node_table", f"{KG}, n AS (SELECT x AS node, xtype AS type FROM kg_edge UNION SELECT y, ytype FROM kg_edge) SELECT type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM n), 6) AS pct FROM n GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), 100.0 FROM n")
def _(spark, d):
    return kg.node_table(kg_edges(spark, d))


@query("kg_counts_displayed", f"{KG} SELECT relation, {DISPLAY_SQL} AS display, xtype, ytype, count(*) AS n_rows, count(DISTINCT (x, y)) AS n_edges FROM kg_edge WHERE relation IN ('supplier_part', 'part_brand', 'rev-part_type') GROUP BY ALL")
def _(spark, d):
    """Edge counts of some relations under the names that reports show."""
    display = F.coalesce(pick(DISPLAY, F.col("relation")), F.col("relation"))
    return kg.displayed_counts(kg_edges(spark, d), display, ["supplier_part", "part_brand", "rev-part_type"])


@query("names_holding", "WITH p AS (SELECT p_partkey, [p_name, p_brand, p_type] AS names FROM part), h AS (SELECT *, list_filter(names, lambda x: contains(lower(x), 'an')) AS hit FROM p) SELECT p_partkey, array_to_string(names, '|') AS names, hit[1] AS first FROM h WHERE len(hit) > 0")
def _(spark, d):
    """All names of the parts of which one holds a text, and which is the first."""
    p = kg.names_holding(table(spark, d, "part"), "p_partkey", F.array("p_name", "p_brand", "p_type"), "AN")
    return p.select("p_partkey", F.array_join("names", "|").alias("names"), "first")


FIND_SQL = """e AS (SELECT s_suppkey::VARCHAR AS id, s_name AS name, 'Nr. ' || (s_suppkey % 50) AS alt FROM supplier),
  m AS (SELECT DISTINCT unnest([l_suppkey::VARCHAR, (l_suppkey + 1000000)::VARCHAR, 'Nr. ' || (l_suppkey % 60), 'NR ' || (l_suppkey % 60), replace(lower(s_name), '#', '--'), s_name]) AS mention FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  norm AS (SELECT id, trim(regexp_replace(lower(unnest([name, alt])), '[^a-z0-9]+', ' ', 'g')) AS n FROM e),
  k AS (SELECT 0 AS kind, id AS text, id FROM e UNION ALL SELECT 1, name, id FROM e UNION ALL SELECT 2, alt, id FROM e UNION ALL SELECT 3, n, id FROM norm),
  a AS (SELECT mention, min([lpad(kind::VARCHAR, 2, '0'), k.id]) AS best FROM m JOIN k ON text = CASE WHEN kind = 3 THEN trim(regexp_replace(lower(mention), '[^a-z0-9]+', ' ', 'g')) ELSE mention END GROUP BY 1)"""


@query("find_entity", f"WITH {FIND_SQL} SELECT mention, best[2] AS found, CASE best[1] WHEN '00' THEN 'id' WHEN '01' THEN 'name' WHEN '02' THEN 'alternate' WHEN '03' THEN 'normalised' END AS how FROM m LEFT JOIN a USING (mention)")
def _(spark, d):
    """Suppliers looked for by id, then name, then alternate, then normalised name, of mentions in the order lines."""
    s = table(spark, d, "supplier")
    e = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Nr. "), (F.col("s_suppkey") % 50).cast("string"))).alias("alternates"))
    k, number = F.col("s_suppkey"), (F.col("s_suppkey") % 60).cast("string")
    said = F.array(k.cast("string"), (k + 1_000_000).cast("string"), F.concat(F.lit("Nr. "), number), F.concat(F.lit("NR "), number), F.replace(F.lower("s_name"), F.lit("#"), F.lit("--")), F.col("s_name"))
    ordered = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct().join(s, "s_suppkey")
    return entities.find(ordered.select(F.explode(said).alias("mention")).distinct(), "mention", e, "id", "name", "alternates")


@query("id_round_trip", "SELECT p_partkey, 'DrugBank:DB' || lpad(p_partkey::VARCHAR, 5, '0') AS node, 'DB:DB' || lpad(p_partkey::VARCHAR, 5, '0') AS drug_id, true AS same FROM part")
def _(spark, d):
    """Ids of drugs as nodes and back."""
    node = F.concat(F.lit("DrugBank:DB"), F.lpad(F.col("p_partkey").cast("string"), 5, F.lit("0")))
    p = table(spark, d, "part").select("p_partkey", node.alias("node")).withColumn("drug_id", t.node_to_drug_id(F.col("node")))
    return p.withColumn("same", t.drug_id_to_node(F.col("drug_id")) == F.col("node"))


@query("lists_between_marks", """WITH a AS (SELECT conv_id, turn, 'Here: <list> ["' || replace(replace(split_part(text, ' ', 1), '\\', ''), '"', '') || '", "' || role || '"] </list> and [no list] <list>["' || turn || '"]</list>' AS t, replace(replace(split_part(text, ' ', 1), '\\', ''), '"', '') AS w, role FROM conversations WHERE text NOT LIKE chr(10) || '%' AND split_part(text, ' ', 1) NOT LIKE '%' || chr(10) || '%')
  SELECT conv_id, turn, w || '|' || role AS first, w || '|' || role || '|' || turn AS every FROM a""")
def _(spark, d):
    """JSON lists between marks in texts that have other brackets too."""
    w = F.replace(F.replace(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("\\"), F.lit("")), F.lit('"'), F.lit(""))
    c = table(spark, d, "conversations").where(~F.contains(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("\n")))
    said = F.concat(F.lit('Here: <list> ["'), w, F.lit('", "'), "role", F.lit('"] </list> and [no list] <list>["'), F.col("turn").cast("string"), F.lit('"]</list>'))
    one, many = t.json_list_between(said, "<list>", "</list>"), t.json_list_between(said, "<list>", "</list>", several=True)
    return c.select("conv_id", "turn", F.array_join(one, "|").alias("first"), F.array_join(many, "|").alias("every"))
