"""Distributed resampling against replays, closed forms and enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.operators import resampling as r

X = [1, 2, 2, 3, 5, 8, 13, 1, 0, 4, 4, 9]


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, float(v), "g" if k % 3 else "h") for k, v in enumerate(X)] + [(90, None, "g"), (91, float("nan"), "g")]
    return spark.createDataFrame(rows, "k long, v double, grp string")


def test_weights_are_poisson(spark):
    w = r.with_weight(spark.range(400).crossJoin(spark.range(100).withColumnRenamed("id", "b")), "id", "b", 7).toPandas().w.to_numpy()
    for k in range(5):
        assert math.isclose((w == k).mean(), math.exp(-1) / math.factorial(k), abs_tol=0.01)
    assert math.isclose(w.mean(), 1, abs_tol=0.02) and math.isclose(w.var(), 1, abs_tol=0.05)


def test_replicates_are_those_of_the_weights(spark, values):
    """Each replicate is the stratified mean of the rows by their weights."""
    _, drawn = r.replicates_of(values, [F.col("v")], F.col("k"), F.col("grp"), r.MEAN, 50, 3)
    got = {x.b: x.value for x in drawn.collect()}
    w = {(x.k, x.b): x.w for x in r.with_weight(values.crossJoin(spark.range(50).withColumnRenamed("id", "b")), "k", "b", 3).collect()}
    for b in range(50):
        total = 0
        for at in ([k for k in range(12) if k % 3], [k for k in range(12) if not k % 3]):
            n = sum(w[k, b] for k in at)
            total += len(at) * sum(w[k, b] * X[k] for k in at) / n if n else sum(X[k] for k in at)
        assert math.isclose(got[b], total / 12)


def test_intervals(spark, values):
    x = np.array(X)
    for method in ("bca", "percentile", "basic"):
        b = r.bootstrap(values, [F.col("v")], F.col("k"), method=method, replicates=600).first()
        assert math.isclose(b.value, x.mean()) and b.low < b.value < b.high and b.n == 12
    assert math.isclose(b.stderr, x.std() / math.sqrt(12), rel_tol=0.15)
    one = r.bootstrap(values, [F.col("v")], F.col("k"), alternative="greater", replicates=200).first()
    assert one.high == math.inf and one.low < one.value
    v = r.bootstrap(values, [F.col("v")], F.col("k"), statistic=r.VARIANCE, replicates=300).first()
    assert math.isclose(v.value, x.var()) and v.low < v.high
    q = r.bootstrap(values, [F.col("v"), F.col("k") + 1], F.col("k"), statistic=r.RATIO, replicates=300).first()
    assert math.isclose(q.value, x.sum() / np.arange(1, 13).sum())


def test_bca_by_hand(spark, values):
    """Bias and acceleration from the replicates and a plain jackknife."""
    from statistics import NormalDist

    b = r.bootstrap(values, [F.col("v")], F.col("k"), replicates=400, seed=5).first()
    draws = np.array([x.value for x in r.replicates_of(values, [F.col("v")], F.col("k"), None, r.MEAN, 400, 5)[1].collect()])
    x = np.array(X, float)
    left = np.array([np.delete(x, k).mean() for k in range(12)])
    away = left.mean() - left
    a = (away**3).sum() / (6 * (away**2).sum() ** 1.5)
    normal = NormalDist()
    z0 = normal.inv_cdf(((draws < x.mean()).sum() + (draws == x.mean()).sum() / 2) / 400)
    want = [np.quantile(draws, normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal.inv_cdf(0.05), normal.inv_cdf(0.95))]
    assert np.allclose([b.low, b.high], want)


def test_rows_without_numbers(spark, values):
    one = r.bootstrap(values.repartition(3), [F.col("v")], replicates=100, method="percentile").first()
    two = r.bootstrap(values.coalesce(1), [F.col("v")], replicates=100, method="percentile").first()
    assert one == two and one.n == 12


def gap(values, at):
    return np.mean([values[k] for k in at]) - np.mean([values[k] for k in range(len(values)) if k not in at])


def test_few_permutations_are_all_looked_at(spark):
    a, b = [1.0, 4.0, 2.0], [3.0, 6.0, 7.0, 9.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b] + [(None, True), (1.0, None)], "v double, g boolean")
    for alternative, hit in (("two-sided", lambda x, s: abs(x) >= abs(s) - 1e-12), ("less", lambda x, s: x <= s + 1e-12), ("greater", lambda x, s: x >= s - 1e-12)):
        got = r.permutation(df, F.col("v"), F.col("g"), alternative=alternative).first()
        every = [gap(a + b, c) for c in itertools.combinations(range(7), 3)]
        assert got.exact and got.permutations == 35 and math.isclose(got.p, np.mean([hit(x, gap(a + b, (0, 1, 2))) for x in every]))


@pytest.mark.parametrize("block", [50_000, 2])
def test_drawn_permutations_agree_with_all(spark, monkeypatch, block):
    """One block, or a tree of blocks."""
    monkeypatch.setattr(r, "BLOCK_VALUES", block)
    v = [1.0, 4.0, 2.0, 2.0, 8.0, 3.0, 6.0, 7.0, 9.0, 2.0, 5.0, 5.0, 0.5, 3.5]
    df = spark.createDataFrame([(x, k < 5) for k, x in enumerate(v)], "v double, g boolean")
    every = np.array([gap(v, c) for c in itertools.combinations(range(14), 5)])
    seen = gap(v, range(5))
    got = r.permutation(df, F.col("v"), F.col("g"), alternative="greater", replicates=1500).first()
    assert not got.exact and math.isclose(got.statistic, seen) and abs(got.p - (every >= seen - 1e-12).mean()) < 0.04
    pairs = spark.createDataFrame([(x, 4.0 - (k % 3)) for k, x in enumerate(v)], "a double, b double")
    d = np.array([x - (4.0 - (k % 3)) for k, x in enumerate(v)])
    signs = np.array(list(itertools.product((1, -1), repeat=14))) @ d / 14
    got = r.permutation(pairs, F.col("a"), F.col("b"), "samples", alternative="greater", replicates=1500).first()
    assert math.isclose(got.statistic, d.mean()) and abs(got.p - (signs >= d.mean() - 1e-12).mean()) < 0.04


def test_new_pairings(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.5, 9.0], [2.0, 1.0, 4.0, 3.0, 7.0, 1.0, 5.0]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    whole = r.permutation(df, F.col("a"), F.col("b"), "pairings").first()
    assert whole.exact and whole.permutations == 5040 and math.isclose(whole.statistic, np.corrcoef(a, b)[0, 1])
    some = r.permutation(df, F.col("a"), F.col("b"), "pairings", replicates=800).first()
    assert not some.exact and some.permutations == 800 and abs(some.p - whole.p) < 0.07


@pytest.mark.parametrize("n", [1, 2, 7, 10, 50])
def test_shuffles_are_permutations(spark, n):
    got = spark.range(n).crossJoin(spark.range(6).withColumnRenamed("id", "b")).select("b", r._shuffled(F.col("id"), n, F.col("b"), 4).alias("j")).collect()
    by = {}
    for x in got:
        by.setdefault(x.b, []).append(x.j)
    assert all(sorted(v) == list(range(n)) for v in by.values())
    assert n < 10 or len({tuple(v) for v in by.values()}) == 6


def test_monte_carlo_in_parts(spark, values, monkeypatch):
    monkeypatch.setattr(r, "BLOCK_VALUES", 5)
    got = r.monte_carlo(values, F.col("v"), lambda rng, n: rng.exponential(4.0, n), replicates=400).first()
    rng = np.random.default_rng(0)
    want = (rng.exponential(4.0, (20_000, 12)).mean(axis=1) >= np.mean(X)).mean()
    assert math.isclose(got.value, np.mean(X)) and abs(got.p - want) < 0.08


def test_nothing_to_resample(spark, values):
    none = values.limit(0)
    assert r.bootstrap(none, [F.col("v")], F.col("k")).first().value is None
    assert r.monte_carlo(none, F.col("v"), lambda rng, n: rng.random(n)).first().p is None
    for kind in ("independent", "samples", "pairings"):
        assert r.permutation(none, F.col("v"), F.col("k"), kind).first().p is None
    one = r.bootstrap(values.limit(1), [F.col("v")], F.col("k"), replicates=20).first()
    assert one.value == one.low == one.high == 1.0
