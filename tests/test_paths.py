"""Ways through removed nodes, long and many paths, against plain versions."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from graphspark.operators import graphs as g, reachability

SCHEMA = "moa_id long, head string, htype string, relation string, tail string, ttype string"
KIND = {"D": "Drug", "M": "Protein", "N": "Protein", "X": "Disease"}


def edges(spark, *rows, moa=1):
    return spark.createDataFrame([(moa, h, KIND[h[0]], r, t, KIND[t[0]]) for h, r, t in rows], SCHEMA)


def bridged(spark, *rows):
    return sorted((r.head, r.relation, r.tail) for r in g.bridge(edges(spark, *rows), F.col("type") == "Protein").collect())


def test_removed_nodes_that_follow_each_other(spark):
    assert bridged(spark, ("D", "r1", "M1"), ("M1", "r2", "M2"), ("M2", "r3", "X")) == [("D", "r1 :: M1 :: r2 :: M2 :: r3", "X")]
    assert bridged(spark, ("D", "a", "X"), ("D", "r1", "M1"), ("M1", "r2", "X"), ("M1", "r3", "M2"), ("M2", "r4", "X"), ("M2", "r5", "M3")) == [
        ("D", "a", "X"), ("D", "r1 :: M1 :: r2", "X"), ("D", "r1 :: M1 :: r3 :: M2 :: r4", "X"),
    ]


def test_removed_nodes_on_a_cycle(spark):
    got = bridged(spark, ("D", "in", "M1"), ("M1", "a", "M2"), ("M2", "b", "M1"), ("M2", "out", "X"), ("M1", "self", "M1"))
    assert got == [("D", "in :: M1 :: a :: M2 :: out", "X")]


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    rows = [("D", "r", "M1")] + [(f"M{k}", "r", f"M{k + 1}") for k in range(1, n - 1)] + [(f"M{n - 1}", "r", "X")]
    (path,) = g.shortest_paths(edges(spark, *rows), ["Drug"], ["Disease"]).collect()
    assert path.path == ["D", *(f"M{k}" for k in range(1, n)), "X"]


def plain_shortest(rows, start):
    """Of the shortest paths from a node to each that it reaches, the least."""
    step = {}
    for h, _, t in rows:
        step.setdefault(h, set()).add(t)
    best, front = {}, [[start]]
    while front:
        new = {}
        for path in front:
            for t in step.get(path[-1], ()):
                if t not in best:
                    new[t] = min(new.get(t, [*path, t]), [*path, t])
        best |= new
        front = [p for t, p in new.items() if t != start]
    return sorted(best.values())


def test_shortest_paths_of_random_graphs(spark):
    r = random.Random(5)
    for _ in range(6):
        nodes = ["D1", "D2", *(f"M{k}" for k in range(9)), "X1", "X2"]
        rows = [(*r.sample(nodes, 2), "r") for _ in range(26)] + [("D1", "D1", "r")]
        rows = [(h, rel, t) for h, t, rel in rows]
        got = sorted(x.path for x in g.shortest_paths(edges(spark, *rows), ["Drug"]).collect())
        assert got == sorted(plain_shortest(rows, "D1") + plain_shortest(rows, "D2"))


def test_a_ladder_of_sixty_diamonds(spark):
    rows, at = [], "D"
    for k in range(60):
        end = "X" if k == 59 else f"N{k}"
        rows += [(at, "r", f"Ma{k}"), (at, "r", f"Mb{k}"), (f"Ma{k}", "r", end), (f"Mb{k}", "r", end)]
        at = end
    e = edges(spark, *rows)
    e.count()
    began = time.time()
    (row,) = g.path_schemata(e, "Drug", "Disease").collect()
    assert int(row.paths) == 2**60 and len(row.types) == 121 and time.time() - began < 30


def test_schemata_are_those_of_listed_paths(spark):
    r = random.Random(9)
    nodes = ["D1", "D2", *(f"M{k}" for k in range(6)), *(f"N{k}" for k in range(3)), "X1", "X2"]
    parts = []
    for moa in range(8):  # some graphs have cycles
        rows = {(*(sorted(r.sample(nodes, 2)) if moa % 2 else r.sample(nodes, 2)), "r") for _ in range(18)}
        parts.append(edges(spark, *((h, rel, t) for h, t, rel in rows), moa=moa))
    e = parts[0]
    for p in parts[1:]:
        e = e.unionAll(p)
    for to, through in (("Disease", None), (None, None), ("Disease", ["Drug", "Protein", "Disease"])):
        want = Counter((x.moa_id, tuple(x.types)) for x in g.simple_paths(e, "Drug", to, through).collect())
        got = {(x.moa_id, tuple(x.types)): int(x.paths) for x in g.path_schemata(e, "Drug", to, through).collect()}
        assert got == dict(want)
    assert g.path_schemata(e.limit(0), "Drug").count() == 0


def test_probes_are_those_of_the_closure(spark):
    """Random graphs, with and without cycles, against the closure; nodes that aren't there."""
    r = random.Random(13)
    nodes = ["D1", "D2", *(f"M{k}" for k in range(8)), "X1", "X2"]
    e = None
    for moa in range(10):
        rows = {(*(sorted(r.sample(nodes, 2)) if moa % 2 else r.sample(nodes, 2)), "r") for _ in range(8 + 2 * moa)} | ({("M1", "M1", "r")} if moa == 4 else set())
        part = edges(spark, *((h, rel, t) for h, t, rel in rows), moa=moa)
        e = part if e is None else e.unionAll(part)
    reach = {(x.moa_id, x.head, x.tail) for x in g.closure(e).select("moa_id", "head", "tail").collect()}
    there = {(x.moa_id, x.head, x.tail) for x in e.collect()}
    known = {(m, n) for m, h, t in there for n in (h, t)}
    pairs = [(moa, h, t, "x") for moa in range(11) for h in [*nodes, "none", None] for t in [*nodes, "none", None]]
    df = spark.createDataFrame(pairs, "moa_id long, head string, tail string, note string")
    got = {(x.moa_id, x.head, x.tail): (x.has_edge, x.has_path) for x in reachability.has_path(reachability.has_edge(df, e), reachability.labels(e)).collect()}
    assert len(got) == len(pairs)
    for moa, h, t, _ in pairs:
        want = (moa, h, t) in reach or (h == t and (moa, h) in known)
        assert got[moa, h, t] == ((moa, h, t) in there, want), (moa, h, t)


def test_labels_of_a_long_chain(spark):
    """One interval for each node of a chain of 5,000."""
    rows = [("D", "r", "M1")] + [(f"M{k}", "r", f"M{k + 1}") for k in range(1, 5000)]
    found = reachability.labels(edges(spark, *rows)).collect()
    assert len(found) == 5001 and all(len(x.reaches) == 2 for x in found)


def test_labels_do_not_depend_on_the_order_of_rows_or_on_other_graphs(spark):
    r = random.Random(8)
    rows = [(m, f"N{a}", "Protein", "r", f"N{b}", "Protein") for m in range(30) for a, b in {(r.randint(0, 9), r.randint(0, 9)) for _ in range(14)}]
    of = lambda some: {(x.moa_id, x.node): (x.number, x.reaches) for x in reachability.labels(spark.createDataFrame(some, SCHEMA).coalesce(1)).collect()}
    want = of(rows)
    for _ in range(3):
        r.shuffle(rows)
        assert of(rows) == want
    alone = [x for x in rows if x[0] == 7]
    assert of(alone) == {k: v for k, v in want.items() if k[0] == 7}


def test_probes_where_graphs_lie_are_those_answered_by_joins(spark):
    r = random.Random(5)
    rows = []
    for moa, n in [*((m, r.randint(1, 9)) for m in range(25)), (30, 64), (31, 65), (32, 150)]:
        rows += [(moa, f"n{r.randrange(n)}", "T", "r", f"n{r.randrange(n)}", "T") for _ in range(n + r.randint(0, n))]
    rows += [(31, f"n{k}", "T", "r", f"n{k + 1}", "T") for k in range(64)] + [rows[0], (3, None, "T", "r", "n1", "T"), (40, "n1", "T", "r", None, "T")]
    e = spark.createDataFrame(rows, SCHEMA)
    name = lambda: r.choice([*(f"n{r.randrange(9)}" for _ in range(8)), f"n{r.randrange(150)}", "x", None])
    asked = [(moa, name(), [name() for _ in range(r.randint(0, 6))]) for moa in [*range(26), 30, 31, 32, 40, 99, None] for _ in range(12)]
    asked += [(32, f"n{k}", [f"n{r.randrange(150)}" for _ in range(9)]) for k in range(150)] + [(1, "n1", None), asked[5]]
    df = spark.createDataFrame(asked, "moa_id long, head string, tails array<string>")
    pairs = spark.createDataFrame(sorted({(m, h, t) for m, h, ts in asked for t in ts or []}, key=str), "moa_id long, head string, tail string")
    want = {tuple(x) for x in reachability.has_path(reachability.has_edge(pairs, e), reachability.labels(e)).collect()}
    got = [tuple(x) for x in reachability.probed(e, df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len({x[3:] for x in got if x[0] == 32}) == 3 and len({x[3:] for x in got if x[0] is not None and x[0] < 25}) >= 3
    assert reachability.probed(e.limit(0), df).where("has_edge OR has_path").count() == 0 and reachability.probed(e, df.limit(0)).count() == 0


def test_probes_are_shuffled_once_as_numbers(spark):
    from graphspark import catalog

    plan = catalog.queries()["path_probes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)", plan)
    of_graphs = [x for x in dealt if x.startswith(("l_orderkey", "moa_id"))]
    # lines, probes, and probes without a graph, which are none here
    assert len([x for x in of_graphs if x.startswith("l_orderkey")]) == 3 and sum("moa_id" in x or "head" in x for x in of_graphs) <= 1
