"""Resampling against closed forms and enumeration; inputs without rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.operators import answers as a, statistics as s


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, float(v), "g" if k % 3 else "h", k % 2 == 0) for k, v in enumerate([1, 2, 2, 3, 5, 8, 13, 1, 0, 4, 4, 9])] + [(90, None, "g", True), (91, float("nan"), "g", False)]
    return spark.createDataFrame(rows, "k int, v double, grp string, flag boolean")


def test_bootstrap_of_a_mean(spark, values):
    for method in ("bca", "percentile", "basic"):
        r = s.bootstrap(values, F.col("v"), F.col("grp"), method=method, replicates=2000).first()
        assert math.isclose(r.value, 52 / 12) and r.low < r.value < r.high and r.n == 12
    plain = s.bootstrap(values, F.col("v"), method="percentile", replicates=4000).first()
    x = np.array([1, 2, 2, 3, 5, 8, 13, 1, 0, 4, 4, 9])
    assert math.isclose(plain.stderr, x.std() / math.sqrt(12), rel_tol=0.1)
    one = s.bootstrap(values, F.col("v"), alternative="greater", replicates=500).first()
    assert one.high == math.inf and one.low < one.value
    most = s.bootstrap(values, F.col("v"), statistic=lambda v, n: float(v[n > 0].max()), method="percentile", replicates=500).first()
    assert most.value == 13 and most.low < 13


def test_exact_permutations(spark):
    a_, b_ = [1.0, 4.0, 2.0], [3.0, 6.0, 7.0, 9.0]
    df = spark.createDataFrame([(x, True) for x in a_] + [(x, False) for x in b_], "v double, g boolean")
    r = s.permutation(df, F.col("v"), F.col("g")).first()
    both = a_ + b_
    gap = lambda at: np.mean([both[k] for k in at]) - np.mean([both[k] for k in range(7) if k not in at])
    every = [gap(c) for c in itertools.combinations(range(7), 3)]
    assert r.exact and r.permutations == 35 and math.isclose(r.p, np.mean([abs(x) >= abs(gap((0, 1, 2))) - 1e-12 for x in every]))
    drawn = s.permutation(df, F.col("v"), F.col("g"), replicates=30).first()
    assert not drawn.exact and abs(drawn.p - r.p) < 0.25
    pairs = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 1.0, 4.0, 3.0, 7.0])), "a double, b double")
    r = s.permutation(pairs, F.col("a"), F.col("b"), "pairings").first()
    assert r.exact and r.permutations == 120 and math.isclose(r.statistic, np.corrcoef([1, 2, 3, 4, 5], [2, 1, 4, 3, 7])[0, 1])
    r = s.permutation(pairs, F.col("a"), F.col("b"), "samples").first()
    assert r.exact and r.permutations == 32 and math.isclose(r.statistic, -0.4)


def test_nothing_to_resample(spark, values):
    none = values.limit(0)
    assert s.bootstrap(none, F.col("v")).first().value is None
    assert s.stratified_bootstrap(none, F.col("flag"), "grp").first().mean is None
    assert s.permutation_test(values.where("flag"), F.col("flag"), F.col("flag")).first().p is None
    assert s.monte_carlo_test(none, F.col("flag"), 0.5).first().p is None
    assert s.monte_carlo(none, F.col("v"), lambda rng, n: rng.random(n)).first().p is None
    for kind in ("independent", "samples", "pairings"):
        assert s.permutation(none, F.col("v"), F.col("k"), kind).first().p is None
    assert s.group_intervals(none, F.col("flag"), "grp", {"all": F.lit(True)}).count() == 0


def test_groups_count_strata_several_times(spark, values):
    r = {x.group: x for x in s.group_intervals(values, F.col("flag"), "grp", {"all": F.lit(True), "small": F.col("k") < 2, "none": F.col("k") < 0}, upsample={"h": 3}).collect()}
    h, g = 4, 10
    assert set(r) == {"all", "small"} and r["all"].n == 3 * h + g and r["small"].n == 4


def test_options_that_nobody_chose(spark):
    df = spark.createDataFrame([("m", "a"), ("m", None), ("m", "a"), ("n", "b")], "model string, option_key string")
    got = {(r.model, r.option_key): (r.n, r.share) for r in a.option_report(df, ["a", "b"], "model").collect()}
    assert got == {("m", "a"): (2, 0.666667), ("m", "b"): (0, 0.0), ("m", None): (1, 0.333333), ("m", "Totals"): (3, 1.0), ("n", "a"): (0, 0.0), ("n", "b"): (1, 1.0), ("n", None): (0, 0.0), ("n", "Totals"): (1, 1.0)}
    whole = {r.option_key: r.n for r in a.option_report(df, ["a", "b"]).collect()}
    assert whole == {"a": 2, "b": 1, None: 1, "Totals": 4}


def test_null_answers_count_as_wrong(spark):
    df = spark.createDataFrame([(None, "DELETE_LINK", True), (None, "DELETE_LINK", False), ("No Effect", None, False), ("Fully Blocked", "CHANGE_LINK", True)], "o string, q string, p boolean")
    ok = a.edit_link_correct(F.col("o"), F.col("q"), F.col("p"))
    assert [r[0] for r in df.select(ok).collect()] == [False, False, False, True]


def test_nested_metrics(spark):
    df = spark.createDataFrame([("m", 2, (0.5, None), 7.0), ("m", 1, (0.25, 1.0), None)], "model string, run int, b struct<x:double,y:double>, z double")
    got = {r.metric: r["values"] for r in a.flattened(df, ["model"]).collect()}
    assert got == {"b/x": [0.25, 0.5], "b/y": [1.0, None], "z": [None, 7.0]}
    absent = a.main_metrics(df, ["model"], ["z", "none"]).collect()
    assert all(math.isnan(r.none) for r in absent) and sorted(map(str, (r.z for r in absent))) == ["7.0", "nan"]
