"""Whole pairs of graphs, matched in two passes over the edges, against the operators that find each part by itself."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphspark import catalog
from graphspark.operators import graphs as g, matching as m, synthesis as syn

SCHEMA = "moa_id long, head string, htype string, relation string, tail string, ttype string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    kinds = {"D": "Drug", "P": "Protein", "G": "Gene", "X": "Disease"}
    rows = []
    for moa in range(30):
        nodes = [f"{k}{i}" for k in ("D", "P", "P", "P", "G", "G", "X") for i in [r.randint(0, 4)]]
        for _ in range(r.randint(2, 14)):  # cycles, self-loops and parallel edges as well
            a, b = r.choice(nodes), r.choice(nodes)
            rows.append((moa, a, kinds[a[0]], r.choice(["up", "down", None]), b, kinds[b[0]]))
    rows += [rows[0], (3, None, "Protein", "up", "X9", "Disease"), (3, "P0", "Protein", "up", None, "Disease"), (41, None, "Drug", "up", None, "Disease")]
    e = spark.createDataFrame(rows, SCHEMA)
    pairs = [(f"{a}|{b}", a, b) for a in range(30) for b in r.sample(range(30), 4)] + [("3|41", 3, 41), ("41|3", 41, 3), ("3|3", 3, 3), ("3|99", 3, 99), ("99|3", 99, 3), ("99|98", 99, 98), ("|3", None, 3)]
    pairs = spark.createDataFrame(list(dict.fromkeys(pairs)), "pair string, ref_id long, target_id long")
    near = spark.createDataFrame([(f"P{a}", f"P{b}", r.choice([0.5, 0.7, 0.7, 1.0])) for a in range(5) for b in range(5) if r.random() < 0.6], "ref string, target string, score double")
    return e, pairs, near


@pytest.mark.parametrize("homomorphic", [False, True])
def test_whole_pairs_are_those_found_one_by_one(spark, corpus, homomorphic):
    e, pairs, near = corpus
    candidates = pairs.select("pair", "target_id").crossJoin(near)
    nodes = g.nodes_of(e, "moa_id")
    side = lambda s: nodes.select(F.col("moa_id").alias(f"{s}_id"), F.col("node").alias(s), F.col("type").alias(f"{s}_type"))
    both = pairs.join(side("ref"), "ref_id").join(side("target"), "target_id").where("ref_type = target_type")
    scores = both.where("ref_type = 'Protein'").join(near, ["ref", "target"]).select("pair", "ref", "target", "score")
    scores = scores.unionByName(both.where("ref_type <> 'Protein' AND ref = target").select("pair", "ref", "target", F.lit(1.0).alias("score")))
    ends = syn.ends(e, "Drug", "Disease")
    end = lambda s: ends.select(F.col("moa_id").alias(f"{s}_id"), F.col("drug").alias(f"{s}_drug"), F.col("disease").alias(f"{s}_disease"))
    forced = pairs.join(end("ref"), "ref_id").join(end("target"), "target_id")
    forced = forced.select("pair", F.inline(F.array(*(F.struct(F.col(f"ref_{c}").alias("ref"), F.col(f"target_{c}").alias("target")) for c in ("drug", "disease")))))
    mapping = m.greedy_mapping(scores, ["pair"], forced=forced).localCheckpoint()
    prompts = nodes.where("type = 'Gene'").select(F.col("moa_id").alias("ref_id"), "node").join(pairs, "ref_id").select("pair", "node")
    want = m.match_graphs(pairs, e, e, mapping, ends, prompts, homomorphic)
    matched = m.matched_pairs(pairs, e, candidates, "Drug", "Disease", ["Protein"], ["Gene"], 3, homomorphic).localCheckpoint()
    assert {tuple(x) for x in matched.select("pair", F.inline("mapping")).collect()} == {tuple(x) for x in mapping.collect()}
    plain = lambda df: {x.pair: tuple(None if isinstance(v, float) and math.isnan(v) else v for v in x) for x in df.collect()}
    got = m.pair_scores(matched)
    assert got.columns == want.columns and plain(got) == plain(want) and len(plain(got)) == pairs.count() > 100
    assert sum(x.n_edges_consistent > 0 for x in got.collect()) > 20


def test_no_pairs_and_no_candidates(spark, corpus):
    e, pairs, near = corpus
    candidates = pairs.select("pair", "target_id").crossJoin(near)
    assert m.matched_pairs(pairs.limit(0), e, candidates.limit(0), "Drug", "Disease", ["Protein"], ["Gene"], 3).count() == 0
    assert m.matched_pairs(pairs, e.limit(0), candidates, "Drug", "Disease", ["Protein"], ["Gene"], 3).where("n_nodes_matched = 0").count() == pairs.count()


@pytest.mark.parametrize("name", ["graph_node_mapping", "graph_match_score", "graph_match_homomorphic"])
def test_references_alone_are_shuffled(spark, name):
    """Edges stay where the lines are dealt: no exchange has their ends, and rows of pairs are dealt by graph."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.split("\n") if "Exchange" in x]
    assert not any(k in x for x in lines for k in ("pair", "head", "node#")) and sum("hashpartitioning(l_orderkey" in x for x in lines) <= 2
