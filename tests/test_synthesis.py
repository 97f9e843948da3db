"""Counts of sources by inclusion and exclusion against the listed exclusions, with and without indications."""

import random

import pytest
from pyspark.sql import functions as F

from graphspark import catalog
from graphspark.operators import synthesis as syn

SCHEMA = "moa_id long, head string, htype string, relation string, tail string, ttype string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Small graphs of few drugs, proteins and diseases; some hold other drugs as nodes."""
    r = random.Random(3)
    rows = []
    for moa in range(40):
        drug, disease = f"D{r.randint(0, 5)}", f"X{r.randint(0, 3)}"
        proteins = [f"P{k}" for k in sorted(r.sample(range(8), r.randint(1, 3)))]
        for p in proteins:
            rows += [(moa, drug, "Drug", "up", p, "Protein"), (moa, p, "Protein", "up", disease, "Disease")]
        if moa % 3 == 0:
            rows.append((moa, drug, "Drug", "up", f"D{(int(drug[1]) + 1) % 6}", "Chemical"))
            rows.append((moa, f"D{(int(drug[1]) + 1) % 6}", "Chemical", "up", proteins[0], "Protein"))
    e = spark.createDataFrame(rows, SCHEMA)
    drug = {m: h for m, h, t, *_ in rows if t == "Drug"}
    ends = spark.createDataFrame([(m, drug[m], next(t for mm, _, _, _, t, k in rows if mm == m and k == "Disease")) for m in range(40)], "moa_id long, drug string, disease string")
    targets = e.where("htype = 'Protein'").selectExpr("moa_id", "head AS protein").distinct()
    known = spark.createDataFrame([("D0", "X1"), ("D2", "X1"), ("D2", "X1"), ("D3", "X0"), ("D9", "X2")], "drug string, disease string")
    return e, ends, targets, known


@pytest.mark.parametrize("indications", [False, True])
def test_counted_and_listed_exclusions_agree(spark, corpus, indications):
    e, ends, targets, known = corpus
    known = known if indications else None
    out = {}
    for x in syn.exclusions(e, ends, targets, "Protein", known).collect():
        out[x.target_moa, x.protein] = out.get((x.target_moa, x.protein), 0) + 1
    of = {x.moa_id: x.disease for x in ends.collect()}
    want = {(t.moa_id, t.protein): sum(d != of[t.moa_id] for d in of.values()) - out.get((t.moa_id, t.protein), 0) for t in targets.collect()}
    assert {(x.target_moa, x.protein): x.sources for x in syn.eligible_sources(e, ends, targets, "Protein", known).collect()} == want
    samples = targets.selectExpr("moa_id AS target_moa", "protein").crossJoin(ends.selectExpr("moa_id AS source_moa"))
    kept = {}
    for x in syn.admissible(samples, e, ends, "Protein", known).collect():
        kept[x.target_moa, x.protein] = kept.get((x.target_moa, x.protein), 0) + 1
    assert kept == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("indications", [False, True])
def test_graphs_of_frequent_drugs_are_dealt_by_protein(spark, corpus, monkeypatch, indications):
    """The same counts where each drug has more graphs than are worked on in one place, with ends that are no nodes, proteins that no graph holds, and nulls."""
    e, ends, targets, known = corpus
    ends = ends.where("moa_id <> 5").unionAll(spark.createDataFrame([(5, "D0", "X9"), (50, "D1", "X1"), (51, "D1", None)], ends.schema))
    targets = targets.unionAll(spark.createDataFrame([(1, "P99"), (2, "D3"), (50, "P1"), (51, "P1"), (60, "P1"), (3, None)], targets.schema))
    known = known.unionAll(spark.createDataFrame([("D1", "X9"), (None, "X1"), ("D1", None)], known.schema)) if indications else None
    out = {}
    for x in syn.exclusions(e, ends, targets, "Protein", known).collect():
        out[x.target_moa, x.protein] = out.get((x.target_moa, x.protein), 0) + 1
    of = {x.moa_id: x.disease for x in ends.collect()}
    want = {(t.moa_id, t.protein): sum(d != of[t.moa_id] for d in of.values()) - (out.get((t.moa_id, t.protein), 0) if t.protein else 0) for t in targets.collect() if of.get(t.moa_id)}
    for most in (20_000, 2):
        monkeypatch.setattr(syn, "DRUG_GRAPHS", most)
        got = syn.eligible_sources(e, ends, targets, "Protein", known).collect()
        assert len(got) == len(want) and {(x.target_moa, x.protein): x.sources for x in got} == want


def test_packed_ends_are_ends_and_targets(spark, corpus):
    e = corpus[0].unionAll(corpus[0].limit(9)).unionAll(spark.createDataFrame([(70, "D1", "Drug", "up", "P1", "Protein")], SCHEMA))
    froms, inverse = ["Drug", "Protein"], {"up": "down"}
    packed = syn.packed_ends(e, "Drug", "Disease", "Protein", froms, inverse).collect()
    assert {(x.moa_id, x.drug, x.disease) for x in packed} == {tuple(x) for x in syn.ends(e, "Drug", "Disease").collect()}
    assert {(x.moa_id, p.protein) for x in packed for p in x.proteins} == {(x.moa_id, x.protein) for x in syn.targets(e, "Protein", froms, inverse).collect() if x.moa_id != 70}
    nodes = {tuple(x) for x in syn.nodes_of(e, "moa_id").collect() if x.moa_id != 70}
    assert {(x.moa_id, n) for x in packed for n in x.nodes} == {x[:2] for x in nodes} and {(x.moa_id, n) for x in packed for n in x.held} == {x[:2] for x in nodes if x[2] == "Protein"}


@pytest.mark.parametrize("name", ["eligible_sources", "eligible_with_indications"])
def test_graphs_are_packed_in_one_pass_over_the_lines(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(syn, "_written", lambda df, label, f=syn._written: written.append(df) or f(df, label))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [catalog.queries()[name](spark, "/root/testdata/sf0.001"), *written]]
    assert sum("FileScan" in line and "l_orderkey" in line for plan in plans for line in plan.split("\n")) == 1


def test_whole_samples_are_those_found_one_by_one(spark, corpus):
    e = corpus[0].withColumn("relation", F.when(F.crc32(F.concat_ws("|", "moa_id", "head", "tail").cast("binary")) % 3 == 0, "down").otherwise("up"))
    ring = [(100, "D0", "Drug", "up", "P0", "Protein"), (100, "P0", "Protein", "up", "P1", "Protein"), (100, "P1", "Protein", "up", "P0", "Protein"), (100, "P1", "Protein", "down", "X1", "Disease")]
    e = e.unionAll(spark.createDataFrame([*ring, (101, "D1", "Drug", "up", "P5", "Protein"), (102, None, "Drug", "up", "P5", "Protein")], SCHEMA))
    signs, inverse, froms = {"up": 1, "down": -1}, {"up": "down", "down": "up"}, ["Drug", "Chemical"]
    ids = e.selectExpr("moa_id AS target_moa").distinct()
    pairs = ids.crossJoin(ids.withColumnRenamed("target_moa", "source_moa")).unionAll(spark.createDataFrame([(7, None), (7, 999)], "a long, b long"))
    ends = syn.ends(e, "Drug", "Disease")
    least = syn.nodes_of(e, "moa_id").where("type = 'Protein'").groupBy(F.col("moa_id").alias("source_moa")).agg(F.min("node").alias("source_node"))
    s = syn.targets(e, "Protein", froms, inverse).withColumnRenamed("moa_id", "target_moa").join(pairs, "target_moa").join(least, "source_moa")
    s = syn.with_relations(syn.admissible(s, e, ends, "Protein"), e, signs, inverse, "Drug")
    key = ["target_moa", "protein", "in_relation", "source_moa", "source_node", "source_level", "target_level", "new_relation"]
    want = {tuple(x[c] for c in key): set() for x in s.collect()}
    for x in syn.synthesised(s.withColumn("key", F.struct(*key)), e, ends, "key").collect():
        want[tuple(x.key)].add(tuple(x)[1:])
    got = syn.linked(e, pairs, signs, inverse, "Drug", "Disease", "Protein", froms, 3).collect()
    assert len(got) == len(want) > 100 and {tuple(x[c] for c in key): {tuple(y) for y in x.edges} for x in got} == want
    assert all(len(x.edges) == len(set(x.edges)) for x in got)
    bare = syn.linked(e, pairs, signs, inverse, "Drug", "Disease", "Protein", froms, 3, ways=False)
    assert bare.columns == key and {tuple(x) for x in bare.collect()} == set(want)


def test_samples_alone_look_for_no_way(spark):
    plan = catalog.queries()["add_link_samples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "way" not in plan and "edges" not in plan


@pytest.mark.parametrize("name", ["add_link_samples", "add_link_graphs"])
def test_the_lines_are_read_once_for_each_side(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[l_orderkey#") and sum("FileScan" in x and "l_orderkey" in x for x in plan.split("\n")) == 2
    assert sum("Exchange" in x and "hashpartitioning(l_orderkey" in x for x in plan.split("\n")) <= 2
