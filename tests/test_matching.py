"""Matching of names, nodes and graphs against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphspark.operators import matching as m


def test_greedy_mapping_against_a_plain_loop(spark):
    r = random.Random(3)
    rows = [(g, f"r{r.randrange(6)}", f"t{r.randrange(6)}", round(r.random(), 1), r.choice("AB"), r.choice("AB")) for g in range(30) for _ in range(14)]
    rows += [(0, None, "t1", 0.9, "A", "A"), (0, "r1", "t1", None, "A", "A")]
    df = spark.createDataFrame(rows, "g int, ref string, target string, score double, ref_type string, target_type string")
    for same in (None, {"A": ["B"]}):
        want = set()
        for g in range(30):
            used_r, used_t = set(), set()
            ok = [x for x in rows if x[0] == g and x[1] and x[3] is not None and x[3] >= 0.5 and (x[4] == x[5] or x[5] in (same or {}).get(x[4], []))]
            for _, a, b, s, _, _ in sorted(ok, key=lambda x: (-x[3], x[1], x[2])):
                if a not in used_r and b not in used_t:
                    want.add((g, a, b, s))
                    used_r.add(a)
                    used_t.add(b)
        assert {tuple(x) for x in m.greedy_mapping(df, ["g"], same=same).collect()} == want


def test_forced_pairs_come_first(spark):
    df = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "y", 0.8)], "g int, ref string, target string, score double")
    forced = spark.createDataFrame([(1, "a", "y"), (1, None, "q")], "g int, ref string, target string")
    assert [tuple(x) for x in m.greedy_mapping(df, ["g"], forced=forced).collect()] == [(1, "a", "y", 999.0)]


def test_rare_grams_lose_no_pair(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randint(3, 9))) for _ in range(80)]
    names = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, name string")
    asked = spark.createDataFrame([(k, w[1:] + "a") for k, w in enumerate(words)] + [(900, ""), (901, None)], "q int, text string")
    v = [m.Vectors("char", 1, 3)]
    every = {(x.q, x.k): x.score for x in m.scores(asked, "q", "text", names, "k", "name", v).collect()}
    for least in (0.3, 0.6, 0.9):
        assert {(x.q, x.k): x.score for x in m.scores(asked, "q", "text", names, "k", "name", v, least).collect()} == {p: s for p, s in every.items() if s >= least}


def test_vector_parameters(spark):
    names = spark.createDataFrame([(1, "the red fox"), (2, "the blue fox"), (3, "a red hen")], "k int, name string")
    grams = lambda **p: {x.gram for x in m.fit(names, "k", "name", m.Vectors("word", 1, 1, **p))[0].collect()}
    assert grams() == {"the", "red", "fox", "blue", "a", "hen"}
    assert grams(stop_words=("the", "a")) == {"red", "fox", "blue", "hen"}
    assert grams(min_df=2) == {"the", "red", "fox"} and grams(max_df=0.4) == {"blue", "a", "hen"} and grams(max_features=1) == {"fox"}
    weights = [x.w for x in m.fit(names, "k", "name", m.Vectors("word", 1, 2, use_idf=False, norm=False))[1].collect()]
    assert set(weights) == {1.0} and len(weights) == 15


def edges(spark, *rows):
    return spark.createDataFrame([(g, a, "X", "r", b, "X") for g, a, b in rows], "moa_id string, head string, htype string, relation string, tail string, ttype string")


def test_graph_scores_of_literal_graphs(spark):
    ref = edges(spark, ("g", "D", "A"), ("g", "A", "B"), ("g", "B", "S"), ("g", "D", "C"), ("g", "C", "S"))
    target = edges(spark, ("h", "d", "a"), ("h", "a", "q"), ("h", "q", "s"))
    pairs = spark.createDataFrame([("p", "g", "h")], "pair string, ref_id string, target_id string")
    ends = spark.createDataFrame([("g", "D", "S"), ("h", "d", "s")], "moa_id string, drug string, disease string")
    mapping = spark.createDataFrame([("p", "D", "d"), ("p", "S", "s"), ("p", "A", "a")], "pair string, ref string, target string")
    prompts = spark.createDataFrame([("p", "A"), ("p", "B")], "pair string, node string")
    for homomorphic in (False, True):
        got = m.match_graphs(pairs, ref, target, mapping, ends, prompts, homomorphic).first()
        assert (got.n_nodes_ref, got.n_nodes_matched, got.n_edges_ref, got.n_edges_ref_reduced) == (5, 3, 5, 3)
        # reduced reference: D-A, A-S, D-S; the target joins d-a and a-s by paths, d-s only by a path through the matched a
        assert got.n_edges_consistent == (2 if homomorphic else 3)
        assert math.isclose(got.node_match, 0.6) and math.isclose(got.interior_match, 1 / 3, abs_tol=1e-6) and got.prompt_match == 0.5
    only_ends = mapping.where("ref <> 'A'")
    got = m.match_graphs(pairs, ref, target, only_ends, ends).first()
    assert got.n_edges_consistent == 0 and got.edge_match == 0 and math.isnan(got.prompt_match)
    assert m.match_graphs(pairs, ref, target, only_ends, ends, forced=False).first().n_edges_consistent == 1


def test_options(spark):
    with pytest.raises(ValueError):
        m.check_options({"a": "No effect", "b": "no effect at all"})
    assert m.equivalents([["Protein", "GeneFamily"]]) == {"Protein": ["GeneFamily"], "GeneFamily": ["Protein"]}
    options = {"full": "fully blocked", "none": "no effect"}
    df = spark.createDataFrame([(1, "Thoughts.\n\nSummary: *fully blocked* because"), (2, "no"), (3, None), (4, "Talk at length.\n\n**No effect**\n")], "k int, text string")
    said = {r.k: r.said for r in df.select("k", m.option_paragraph(F.col("text"), options).alias("said")).collect()}
    assert said == {1: "fully blocked", 2: "no", 3: None, 4: "No effect"}
    best = {r.k: (r.option_key, r.match_score) for r in m.best_options(df.select("k", m.option_paragraph(F.col("text"), options).alias("t")), "k", "t", options).collect()}
    assert best[1] == ("full", 1.0) and best[3] == (None, 0.0) and best[4] == ("none", 1.0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, text string")
    assert m.scores(none, "k", "text", none.withColumnRenamed("k", "n"), "n", "text", [m.Vectors()]).count() == 0
    assert m.best_options(none, "k", "text", {"a": "x y z"}).count() == 0
    assert list(itertools.chain(m.negative_answers(none, "k", "text", {"YES": "yes", "NO": "no"}).collect())) == []
