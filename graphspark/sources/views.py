"""Graph views of the star-schema tables: small typed graphs (one for each order), a knowledge graph, and sessions.

``MOA_SQL`` and its kin define the same views for an independent SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Relation names by return flag and line status, and their signs (0: unknown).
FLAG_RELATION = {"A": "increases activity of", "N": "decreases activity of", "R": "positively regulates"}
STATUS_RELATION = {"F": "negatively correlated with", "O": "positively correlated with"}
UNKNOWN_LINE = 7
#: Order lines of a partition of the order graphs.
LINES = 100_000
SIGNS = {
    "increases activity of": 1,
    "decreases activity of": -1,
    "positively regulates": 1,
    "negatively correlated with": -1,
    "positively correlated with": 1,
    "located in": 1,
    "manifestation of": 1,
    "has metabolite": 0,
}
INVERSE = {
    "increases activity of": "decreases activity of",
    "decreases activity of": "increases activity of",
    "positively correlated with": "negatively correlated with",
    "negatively correlated with": "positively correlated with",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(mapping: dict, key: Column) -> Column:
    """The value of a small mapping as nested conditions."""
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def order_parts(spark: SparkSession, sf_dir: str) -> int:
    """The number of partitions of the order graphs."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def moa_edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """(moa_id, head, htype, relation, tail, ttype), distinct; all edges of a graph are in one partition.

    Lines and orders are dealt by order into a number of partitions that grows with the lines, so that a task holds no more
    of them in a larger table. What follows by graph (distinct edges, nodes, kernels) stays in these partitions. Edges are
    made distinct as numbers and get their names afterwards. With ``repeated`` they may come more than once, for what
    counts each once itself (kernels, nodes).
    """
    relations = ["has metabolite", *FLAG_RELATION.values(), *STATUS_RELATION.values(), "located in", "manifestation of"]
    number = {r: k + 1 for k, r in enumerate(relations)}
    coded = lambda mapping, c: pick({k: number[r] for k, r in mapping.items()}, F.col(c)).cast("int")
    to_part = F.when(F.col("l_linenumber") == UNKNOWN_LINE, number["has metabolite"]).otherwise(coded(FLAG_RELATION, "l_returnflag"))
    # a task that deals lines holds all of its split: keys and numbers of relations only
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", to_part.alias("to_part"), coded(STATUS_RELATION, "l_linestatus").alias("to_supplier"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    parts = order_parts(spark, sf_dir)
    rows = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey").repartition(parts, "l_orderkey").join(orders.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    none, key = F.lit(None).cast("string"), lambda c: F.col(c).cast("long")
    edge = lambda kind, r, h, t, named=none: F.struct(F.lit(kind).alias("kind"), r.alias("r"), h.alias("h"), t.alias("t"), named.alias("named"))
    edges = F.array(
        edge(0, F.col("to_part"), key("o_custkey"), key("l_partkey")),
        edge(1, F.col("to_supplier"), key("l_partkey"), key("l_suppkey")),
        edge(2, F.lit(number["located in"]), key("l_suppkey"), key("s_nationkey")),
        edge(3, F.lit(number["manifestation of"]), key("s_nationkey"), F.lit(None).cast("long"), F.col("o_orderpriority")),
    )
    found = rows.select(F.col("l_orderkey").alias("moa_id"), F.inline(edges))
    found = found if repeated else found.distinct()
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k)
    kind, text = F.col("kind") + 1, lambda c: F.col(c).cast("string")
    heads, tails = ("Customer", "Part", "Supplier", "Nation"), ("Part", "Supplier", "Nation", "Priority")
    return found.select(
        "moa_id", F.concat(of("CPSN", kind), F.lit(":"), text("h")).alias("head"), of(heads, kind).alias("htype"), of(relations, F.col("r")).alias("relation"),
        F.concat(of("PSNY", kind), F.lit(":"), F.when(F.col("kind") == 3, F.col("named")).otherwise(text("t"))).alias("tail"), of(tails, kind).alias("ttype"),
    )


MOA_SQL = """
  moa_edge AS (
    SELECT DISTINCT o_orderkey AS moa_id, e.head, e.htype, e.relation, e.tail, e.ttype FROM (
      SELECT o_orderkey, unnest([
        {'head': 'C:' || o_custkey, 'htype': 'Customer', 'relation': CASE WHEN l_linenumber = 7 THEN 'has metabolite' WHEN l_returnflag = 'A' THEN 'increases activity of' WHEN l_returnflag = 'N' THEN 'decreases activity of' WHEN l_returnflag = 'R' THEN 'positively regulates' END, 'tail': 'P:' || l_partkey, 'ttype': 'Part'},
        {'head': 'P:' || l_partkey, 'htype': 'Part', 'relation': CASE l_linestatus WHEN 'F' THEN 'negatively correlated with' WHEN 'O' THEN 'positively correlated with' END, 'tail': 'S:' || l_suppkey, 'ttype': 'Supplier'},
        {'head': 'S:' || l_suppkey, 'htype': 'Supplier', 'relation': 'located in', 'tail': 'N:' || s_nationkey, 'ttype': 'Nation'},
        {'head': 'N:' || s_nationkey, 'htype': 'Nation', 'relation': 'manifestation of', 'tail': 'Y:' || o_orderpriority, 'ttype': 'Priority'}]) AS e
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)),
  sign(relation, sign) AS (VALUES ('increases activity of', 1), ('decreases activity of', -1), ('positively regulates', 1), ('negatively correlated with', -1),
    ('positively correlated with', 1), ('located in', 1), ('manifestation of', 1), ('has metabolite', 0))"""


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, xtype, relation, y, ytype) of the knowledge graph, each edge in both directions (``rev-`` back)."""
    t = lambda n: table(spark, sf_dir, n)

    def edges(df: DataFrame, x, xtype, relation, y, ytype) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{x[0]}:"), F.col(x[1]).cast("string")).alias("x"), F.lit(xtype).alias("xtype"), F.lit(relation).alias("relation"),
            F.concat(F.lit(f"{y[0]}:"), F.col(y[1]).cast("string")).alias("y"), F.lit(ytype).alias("ytype"),
        )

    supplies = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    forward = [
        edges(t("supplier"), ("S", "s_suppkey"), "Supplier", "supplier_nation", ("N", "s_nationkey"), "Nation"),
        edges(t("nation"), ("N", "n_nationkey"), "Nation", "nation_region", ("R", "n_regionkey"), "Region"),
        edges(t("customer"), ("C", "c_custkey"), "Customer", "customer_nation", ("N", "c_nationkey"), "Nation"),
        edges(t("part"), ("P", "p_partkey"), "Part", "part_brand", ("B", "p_brand"), "Brand"),
        edges(t("part"), ("P", "p_partkey"), "Part", "part_type", ("T", "p_type"), "Type"),
        edges(supplies, ("S", "l_suppkey"), "Supplier", "supplier_part", ("P", "l_partkey"), "Part"),
    ]
    out = forward[0]
    for f in forward[1:]:
        out = out.unionAll(f)
    both = F.array(
        F.struct("x", "xtype", "relation", "y", "ytype"),
        F.struct(F.col("y").alias("x"), F.col("ytype").alias("xtype"), F.concat(F.lit("rev-"), "relation").alias("relation"), F.col("x").alias("y"), F.col("xtype").alias("ytype")),
    )
    return out.select(F.explode(both).alias("e")).select("e.*")


KG_SQL = """
  kg_forward AS (
    SELECT 'S:' || s_suppkey AS x, 'Supplier' AS xtype, 'supplier_nation' AS relation, 'N:' || s_nationkey AS y, 'Nation' AS ytype FROM supplier
    UNION ALL SELECT 'N:' || n_nationkey, 'Nation', 'nation_region', 'R:' || n_regionkey, 'Region' FROM nation
    UNION ALL SELECT 'C:' || c_custkey, 'Customer', 'customer_nation', 'N:' || c_nationkey, 'Nation' FROM customer
    UNION ALL SELECT 'P:' || p_partkey, 'Part', 'part_brand', 'B:' || p_brand, 'Brand' FROM part
    UNION ALL SELECT 'P:' || p_partkey, 'Part', 'part_type', 'T:' || p_type, 'Type' FROM part
    UNION ALL SELECT DISTINCT 'S:' || l_suppkey, 'Supplier', 'supplier_part', 'P:' || l_partkey, 'Part' FROM lineitem),
  kg_edge AS (SELECT * FROM kg_forward UNION ALL SELECT y, ytype, 'rev-' || relation, x, xtype FROM kg_forward)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, option, score, is_positive, correct, k) of the events: answers of five models."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), (F.col("user_id") % 7).alias("run"),
        F.col("event_type").alias("option"), F.col("value").alias("score"), (F.col("event_id") % 3 != 0).alias("is_positive"),
        F.col("event_type").isin("click", "purchase", "signup").alias("predicted"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id",
    ).withColumn("correct", F.col("is_positive") == F.col("predicted"))


SESSION_SQL = """
  session AS (SELECT *, is_positive = predicted AS correct FROM (
    SELECT event_id, 'm' || (user_id % 5) AS model, user_id % 7 AS run, event_type AS option, value AS score, event_id % 3 <> 0 AS is_positive,
      event_type IN ('click', 'purchase', 'signup') AS predicted, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events))"""


# The options of edited links by their event type (null: no option was found).
EVENT_OPTION = {"click": "Fully Blocked", "purchase": "Partially Blocked", "signup": "No Effect", "view": "Contra-indicated"}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers from the events: option, score, graph sizes and matches, distances of the link."""
    e = table(spark, sf_dir, "events")
    u, i = F.col("user_id"), F.col("event_id")
    long = lambda c: c.cast("long")
    return e.select(
        "event_id", F.concat(F.lit("m"), (u % 5).cast("string")).alias("model"), long(u % 3).alias("session"),
        F.when(i % 2 == 0, "DELETE_LINK").otherwise("CHANGE_LINK").alias("query_type"), pick(EVENT_OPTION, F.col("event_type")).alias("option_key"),
        F.when(F.col("event_type") != "error", (u % 100) / 100).alias("match_score"), (i % 3 != 0).alias("is_positive"),
        (i % 3 != 0).alias("has_ref_graph"), (u % 6 != 0).alias("has_target_graph"),
        long(3 + u % 5).alias("n_nodes_ref"), long(u % 6).alias("n_nodes_target"), long(u % 3).alias("n_prompt_ref_nodes"),
        long(F.least(3 + u % 5, i % 5)).alias("n_nodes_matched_ref"), long(F.least(u % 6, i % 5)).alias("n_nodes_matched_target"), long(F.least(u % 3, i % 2)).alias("n_prompt_ref_nodes_matched"),
        F.when(i % 11 != 0, (i % 7) / 7).alias("interior_node_match_score"), ((i % 9) / 9).alias("edge_match_score_reduced"),
        long(u % 4).alias("from_root"), long(i % 5).alias("from_sink"), pick({0: "Drug", 1: "Protein", 2: "GeneFamily"}, u % 3).alias("source_type"),
    )


ANSWER_SQL = """
  answer AS (SELECT event_id, 'm' || (user_id % 5) AS model, user_id % 3 AS session, CASE WHEN event_id % 2 = 0 THEN 'DELETE_LINK' ELSE 'CHANGE_LINK' END AS query_type,
    CASE event_type WHEN 'click' THEN 'Fully Blocked' WHEN 'purchase' THEN 'Partially Blocked' WHEN 'signup' THEN 'No Effect' WHEN 'view' THEN 'Contra-indicated' END AS option_key,
    CASE WHEN event_type <> 'error' THEN (user_id % 100) / 100 END AS match_score, event_id % 3 <> 0 AS is_positive, event_id % 3 <> 0 AS has_ref_graph, user_id % 6 <> 0 AS has_target_graph,
    3 + user_id % 5 AS n_nodes_ref, user_id % 6 AS n_nodes_target, user_id % 3 AS n_prompt_ref_nodes, least(3 + user_id % 5, event_id % 5) AS n_nodes_matched_ref,
    least(user_id % 6, event_id % 5) AS n_nodes_matched_target, least(user_id % 3, event_id % 2) AS n_prompt_ref_nodes_matched, CASE WHEN event_id % 11 <> 0 THEN (event_id % 7) / 7 END AS interior_node_match_score,
    (event_id % 9) / 9 AS edge_match_score_reduced, user_id % 4 AS from_root, event_id % 5 AS from_sink, CASE user_id % 3 WHEN 0 THEN 'Drug' WHEN 1 THEN 'Protein' ELSE 'GeneFamily' END AS source_type FROM events)"""
