"""Permuted pairs, selection and exact quantiles against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.operators import quantiles, sampling


@pytest.mark.parametrize("n,m", [(1, 1), (1, 17), (13, 1), (7, 11), (64, 3)])
def test_every_pair_once(spark, n, m):
    p = spark.range(n * m).select(sampling.permuted(F.col("id"), F.lit(n), F.lit(m), 5).alias("p")).select("p.i", "p.j").collect()
    assert {(r.i, r.j) for r in p} == {(i, j) for i in range(n) for j in range(m)} and len(p) == n * m


def test_seeds_and_huge_sides(spark):
    at = lambda seed, n: [tuple(r) for r in spark.range(200).select(sampling.permuted(F.col("id"), F.lit(n), F.lit(n), seed).alias("p")).select("p.i", "p.j").collect()]
    assert at(1, 1000) == at(1, 1000) != at(2, 1000)
    wide = at(3, 2_000_000_000)
    assert len(set(wide)) == 200 and all(0 <= i < 2_000_000_000 and 0 <= j < 2_000_000_000 for i, j in wide)
    assert np.std([i for i, _ in wide]) > 3e8


def test_nth_smallest(spark):
    values = random.Random(2).sample(range(100_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 250, 500):
        assert sampling.nth_smallest(df, "v", n, 0, 100_000, bins=8) == sorted(values)[n - 1]
    assert sampling.nth_smallest(df, "v", 501, 0, 100_000) is None


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(k,) for k in [*range(20), 3, 3, None]], "a long")
    right = spark.createDataFrame([(f"d{k}",) for k in [*range(15), 2]] + [(None,)], "b string")
    taken = {(k, f"d{j}") for k in range(20) for j in range(15) if (k * j) % 3}
    return left, right, spark.createDataFrame([*taken, *list(taken)[:9], (None, "d1"), (99, "d1")], "a long, b string"), taken


def drawn(df):
    return [(r.a, r.b) for r in sorted(df.collect(), key=lambda r: r.draw)]


def test_negative_pairs(spark, sides):
    left, right, used, taken = sides
    free = {(k, f"d{j}") for k in range(20) for j in range(15)} - taken
    every = drawn(sampling.negative_pairs(left, right, used, 1000, seed=4))
    assert set(every) == free and len(every) == len(free)
    for n in (1, 10, len(free)):  # a longer draw begins with the shorter ones, however many are drawn at once
        assert drawn(sampling.negative_pairs(left, right, used, n, seed=4, at_once=7)) == every[:n]
    assert drawn(sampling.negative_pairs(left, right, used, 10, seed=5)) != every[:10]


def test_rejects_are_bounded(spark, sides):
    left, right, used, taken = sides
    order = drawn(sampling.negative_pairs(left, right, used.limit(0), 1000, seed=4))
    want, rejects = [], 0
    for p in order:
        rejects += p in taken
        if rejects == 20:
            break
        if p not in taken:
            want.append(p)
    assert drawn(sampling.negative_pairs(left, right, used, 1000, seed=4, most_rejects=20, at_once=16)) == want


def test_nothing_to_draw(spark, sides):
    left, right, used, _ = sides
    assert sampling.negative_pairs(left.limit(0), right, used, 5).collect() == []
    assert sampling.negative_pairs(left, right, used, 0).collect() == []
    assert sampling.negative_pairs(left, right, left.join(right).select("a", "b"), 5).collect() == []


SHARES = {"lo": 0.0, "q": 0.25, "mid": 0.5, "p99": 0.99, "hi": 1.0}


def checked(df, rows, **sizes):
    got = {r.g: r for r in quantiles.group_quantiles(df, ["g"], F.col("v"), SHARES, **sizes).collect()}
    want = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, values in want.items():
        assert got[g].n == len(values)
        for c, p in SHARES.items():
            assert math.isclose(got[g][c], float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-300), (g, c)


@pytest.mark.parametrize("few,bins", [(10_000, 1024), (5, 8)])
def test_quantiles(spark, few, bins):
    """Small groups, one group of 95 %, ties, null keys and values, wide and tiny ranges."""
    r = random.Random(few)
    rows = [("hot", round(r.gauss(0, 10), 3)) for _ in range(1900)] + [("ties", float(k % 2)) for k in range(31)] + [(None, 1.5), ("one", 7.0), ("n", None), ("n", float("nan")), ("hot", None)]
    rows += [("wide", s * 10.0**e) for s in (-1, 1) for e in range(-300, 308, 40)] + [("tiny", k * 5e-324) for k in range(9)]
    checked(spark.createDataFrame(rows, "g string, v double").repartition(4), rows, few=few, bins=bins, parts=3)


def test_quantiles_of_all_rows(spark):
    df = spark.range(1001).select((F.col("id") * 8 % 1001).alias("v"))
    for few in (10_000, 10):
        r = quantiles.group_quantiles(df, [], F.col("v"), {"mid": 0.5, "q": 0.1}, few=few).collect()
        assert [(x.n, x.mid, x.q) for x in r] == [(1001, 500.0, 100.0)]
    assert quantiles.group_quantiles(df.limit(0), [], F.col("v"), {"mid": 0.5}).collect() == []
