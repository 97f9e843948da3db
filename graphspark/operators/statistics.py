"""Metrics, resampling and regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .resampling import MEAN, bootstrap as resampled_sums, monte_carlo, permutation  # noqa: F401


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, zero where b is."""
    return F.when(b == 0, 0.0).otherwise(F.round(a / b, digits))


def binary_metrics(df: DataFrame, true: Column, predicted: Column, *keys: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(
        F.count_if(true & predicted).alias("tp"), F.count_if(~true & predicted).alias("fp"),
        F.count_if(true & ~predicted).alias("fn"), F.count_if(~true & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp, 9), ratio(tp, tp + fn, 9)
    return counts.select(
        *keys, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fn).alias("accuracy_true"),
        ratio(tn, tn + fp).alias("accuracy_false"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        F.when(p + r == 0, 0.0).otherwise(F.round(2 * p * r / (p + r), 6)).alias("f1"),
    )


def _draws(strata: list[tuple[int, float]], replicates: int, seed: int):
    """A map over blocks of replicates: the mean of a 0/1 statistic, each stratum a binomial draw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = np.zeros(len(pdf))
            for k, (n, p) in enumerate(strata):
                for j, b in enumerate(pdf.b):
                    total[j] += np.random.default_rng([seed, k, int(b)]).binomial(n, p)
            yield pd.DataFrame({"b": pdf.b, "mean": total / sum(n for n, _ in strata)})

    return run


def stratified_bootstrap(df: DataFrame, correct: Column, stratum: str, replicates: int = 9999, level: float = 0.9, seed: int = 1) -> DataFrame:
    """One row: mean, BCa and percentile limits, standard error and n of a 0/1 statistic resampled within strata.

    Only the strata's counts reach the driver; replicates are rows.
    """
    spark = df.sparkSession
    counts = df.where(correct.isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("s")).orderBy(stratum).collect()
    strata = [(r.n, r.s / r.n) for r in counts]
    n, s = sum(r.n for r in counts), sum(r.s for r in counts)
    if n < 2:  # no jackknife
        value = F.lit(float(s) if n else None).cast("double")
        return spark.range(1).select(*(value.alias(c) for c in ("mean", "low", "high", "percentile_low", "percentile_high")), F.lit(None).cast("double").alias("stderr"), F.lit(n).alias("n"))
    mean = s / n
    draws = spark.range(replicates).withColumnRenamed("id", "b").mapInPandas(_draws(strata, replicates, seed), "b long, mean double")
    r = draws.agg(F.count_if(F.col("mean") < mean).alias("below"), F.count_if(F.col("mean") == mean).alias("same"), F.stddev_samp("mean").alias("se"))
    normal = NormalDist()
    below = r.first()
    share = min(max((below.below + below.same / 2) / replicates, 0.5 / replicates), 1 - 0.5 / replicates)
    z0 = normal.inv_cdf(share)
    # jackknife of a mean in closed form: only two distinct values occur
    one, zero = (s - 1) / (n - 1), s / (n - 1)
    center = (s * one + (n - s) * zero) / n
    cubes = s * (center - one) ** 3 + (n - s) * (center - zero) ** 3
    squares = s * (center - one) ** 2 + (n - s) * (center - zero) ** 2
    a = cubes / (6 * squares**1.5) if squares else 0.0
    adjusted = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf((1 - level) / 2), normal.inv_cdf((1 + level) / 2))]
    low, high = ((1 - level) / 2, (1 + level) / 2)
    return draws.agg(
        F.lit(mean).alias("mean"), F.percentile("mean", F.lit(adjusted[0])).alias("low"), F.percentile("mean", F.lit(adjusted[1])).alias("high"),
        F.percentile("mean", F.lit(low)).alias("percentile_low"), F.percentile("mean", F.lit(high)).alias("percentile_high"),
        F.stddev_samp("mean").alias("stderr"), F.lit(n).alias("n"),
    )


def permutation_test(df: DataFrame, value: Column, group: Column, replicates: int = 999, seed: int = 3) -> DataFrame:
    """One row: difference of two groups' means of a 0/1 value and its two-sided p; the count of ones in the first group
    is hypergeometric under the hypothesis, so a replicate is one draw."""
    spark = df.sparkSession
    c = df.agg(F.count_if(group).alias("n1"), F.count_if(~group).alias("n2"), F.count_if(group & value).alias("s1"), F.count_if(~group & value).alias("s2")).first()
    n1, n2, s1, s2 = c.n1, c.n2, c.s1, c.s2
    if not n1 or not n2:  # nothing to compare
        return spark.range(1).select(F.lit(None).cast("double").alias("difference"), F.lit(None).cast("double").alias("p"), F.lit(0).cast("long").alias("replicates"))
    seen = s1 / n1 - s2 / n2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([np.random.default_rng([seed, int(b)]).hypergeometric(s1 + s2, n1 + n2 - s1 - s2, n1) for b in pdf.b])
            diff = x / n1 - (s1 + s2 - x) / n2
            yield pd.DataFrame({"extreme": np.abs(diff) >= abs(seen) * (1 - 1e-12)})

    hits = spark.range(replicates).withColumnRenamed("id", "b").mapInPandas(run, "extreme boolean")
    return hits.agg(F.lit(seen).alias("difference"), ((F.count_if("extreme") + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("replicates"))


def monte_carlo_test(df: DataFrame, correct: Column, chance: float, replicates: int = 999, seed: int = 5) -> DataFrame:
    """One row: how often as many right answers come by chance."""
    c = df.agg(F.count("*").alias("n"), F.count_if(correct).alias("s")).first()
    if not c.n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([np.random.default_rng([seed, int(b)]).binomial(c.n, chance) for b in pdf.b])
            yield pd.DataFrame({"extreme": x >= c.s})

    hits = df.sparkSession.range(replicates).withColumnRenamed("id", "b").mapInPandas(run, "extreme boolean")
    return hits.agg(F.lit(c.s / c.n).alias("share"), ((F.count_if("extreme") + 1) / (F.count("*") + 1)).alias("p"))


def logistic_depth(df: DataFrame, features: list[str], label: str, splits: int = 100, seed: int = 9) -> DataFrame:
    """Accuracy and coefficients over random halves: sufficient counts are grouped first, so each split fits on few rows."""
    cells = df.groupBy(*features, label, (F.abs(F.xxhash64("key")) % 64).alias("part")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        split = int(pdf.split.iloc[0])
        train = np.random.default_rng([seed, split]).permutation(64)[:48]
        x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])
        y, w, mine = pdf[label].to_numpy(float), pdf.n.to_numpy(float), pdf.part.isin(train).to_numpy()
        beta = np.zeros(x.shape[1])
        for _ in range(25):  # iteratively reweighted least squares
            p = 1 / (1 + np.exp(-x[mine] @ beta))
            h = x[mine].T @ (x[mine] * (w[mine] * p * (1 - p))[:, None]) + 1e-6 * np.eye(len(beta))
            beta += np.linalg.solve(h, x[mine].T @ (w[mine] * (y[mine] - p)) - 1e-6 * beta)
        hit = ((x[~mine] @ beta > 0) == (y[~mine] > 0.5)) * w[~mine]
        return pd.DataFrame({"split": [split], "accuracy": [hit.sum() / max(w[~mine].sum(), 1)], "intercept": [beta[0]], **{f"coef_{f}": [b] for f, b in zip(features, beta[1:])}})

    schema = "split int, accuracy double, intercept double, " + ", ".join(f"coef_{f} double" for f in features)
    each = cells.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).groupBy("split").applyInPandas(run, schema)
    names = ["accuracy", "intercept", *(f"coef_{f}" for f in features)]
    return each.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("sd", F.stddev_pop))))


# --------------------------------------------------------------------------
# Statistics that look at all values at once. Those that are sums, and permutations, are in ``resampling``: any number of values.

#: Distinct (stratum, value) pairs that a function of all values gets; more is an error that asks for ``resampling.Sums``.
MOST_VALUES = 100_000


def counted(df: DataFrame, value: Column, *keys: Column) -> pd.DataFrame:
    """Distinct values with their counts, at most ``MOST_VALUES``; null and NaN values go."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    names = [f"k{n}" for n in range(len(keys))]
    rows = df.select(*(k.cast("string").alias(n) for n, k in zip(names, keys)), v.alias("v")).where("v IS NOT NULL").groupBy(*names, "v").agg(F.count("*").alias("n"))
    out = rows.limit(MOST_VALUES + 1).toPandas()
    if len(out) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values for a function of all values: state it as resampling.Sums")
    return out.sort_values([*names, "v"], na_position="first").reset_index(drop=True)


def _resampled(c: pd.DataFrame, statistic, replicates: int, seed: int, spark) -> DataFrame:
    """(b, value): the statistic of draws with replacement within each stratum (k0); draws of equal values are counted together."""
    groups = [g.index.to_numpy() for _, g in c.groupby("k0", dropna=False, sort=True)] if "k0" in c else [c.index.to_numpy()]
    v, n = c.v.to_numpy(float), c.n.to_numpy(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b in pdf.b:
                rng, drawn = np.random.default_rng([seed, int(b)]), np.zeros(len(v), np.int64)
                for at in groups:
                    drawn[at] = rng.multinomial(n[at].sum(), n[at] / n[at].sum())
                out.append(statistic(v, drawn))
            yield pd.DataFrame({"b": pdf.b, "value": out})

    return spark.range(replicates).withColumnRenamed("id", "b").mapInPandas(run, "b long, value double")


def bootstrap(df: DataFrame, value: Column, stratum: Column | None = None, statistic: Callable[[np.ndarray, np.ndarray], float] | None = None, method: str = "bca", alternative: str = "two-sided", replicates: int = 9999, level: float = 0.9, seed: int = 1) -> DataFrame:
    """One row: value, low, high, stderr, n of a statistic of any numbers, resampled within strata.

    method: "bca", "percentile" or "basic"; alternative: "two-sided", "less" (from minus infinity) or "greater" (to
    infinity). The jackknife of "bca" leaves out one value of all. Without values all is null; with one value the limits are
    it. The mean is resampled as sums (``resampling.bootstrap``); another ``statistic`` is called with all distinct values.
    """
    if statistic is None:
        return resampled_sums(df, [value], None, stratum, MEAN, method, alternative, replicates, level, seed)
    spark = df.sparkSession
    c = counted(df, value, *([stratum] if stratum is not None else []))
    n = int(c.n.sum()) if len(c) else 0
    if not n:
        return spark.range(1).select(*(F.lit(None).cast("double").alias(x) for x in ("value", "low", "high", "stderr")), F.lit(0).cast("long").alias("n"))
    v, k = c.v.to_numpy(float), c.n.to_numpy(np.int64)
    seen = statistic(v, k)
    draws = _resampled(c, statistic, replicates, seed, spark).toPandas().value.to_numpy()  # one number for each replicate
    alpha = (1 - level) / 2 if alternative == "two-sided" else 1 - level
    low, high = alpha, 1 - alpha
    if method == "bca" and len(v) > 1:
        normal = NormalDist()
        share = min(max(((draws < seen).sum() + (draws == seen).sum() / 2) / replicates, 0.5 / replicates), 1 - 0.5 / replicates)
        z0 = normal.inv_cdf(share)
        left = np.array([statistic(v, k - (np.arange(len(v)) == j)) for j in range(len(v))])
        away = np.average(left, weights=k) - left
        squares = float((k * away**2).sum())
        a = float((k * away**3).sum()) / (6 * squares**1.5) if squares else 0.0
        low, high = (normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in map(normal.inv_cdf, (low, high)))
    limits = np.quantile(draws, [low, high])
    if method == "basic":
        limits = 2 * seen - limits[::-1]
    bounds = [-np.inf if alternative == "less" else float(limits[0]), np.inf if alternative == "greater" else float(limits[1])]
    row = [(float(seen), *map(float, bounds), float(draws.std(ddof=1)), n)]
    return spark.createDataFrame(row, "value double, low double, high double, stderr double, n long")


def group_intervals(df: DataFrame, correct: Column, stratum: str, groups: dict[str, Column], keys: list[str] = (), upsample: dict[str, int] | None = None, replicates: int = 999, level: float = 0.9, seed: int = 1) -> DataFrame:
    """(keys, group, value, low, high, stderr, n): a table of named filters, each resampled within strata.

    All groups are counted in one pass; only their counts of right and wrong answers reach the driver, and the replicates
    are drawn by tasks. ``upsample`` counts the rows of some strata several times. Groups without rows are left out.
    """
    spark = df.sparkSession
    times = F.lit(1)
    for s, m in (upsample or {}).items():
        times = F.when(F.col(stratum) == s, m).otherwise(times)
    flags = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in groups.items()))
    each = df.withColumn("group", F.explode(F.filter(flags, lambda x: x.isNotNull()))).where(correct.isNotNull())
    counts = each.groupBy(*keys, "group", stratum).agg(F.sum(times.cast("long")).alias("n"), F.sum(F.when(correct, times).otherwise(0).cast("long")).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(stratum)
        n, s = pdf.n.to_numpy(np.int64), pdf.s.to_numpy(np.int64)
        rng = np.random.default_rng([seed, *pdf.group.iloc[0].encode()])
        draws = sum(rng.binomial(a, b / a, replicates) for a, b in zip(n, s)) / n.sum()
        alpha = (1 - level) / 2
        low, high = np.quantile(draws, [alpha, 1 - alpha])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "group": [pdf.group.iloc[0]], "value": [s.sum() / n.sum()], "low": [low], "high": [high], "stderr": [draws.std(ddof=1)], "n": [n.sum()]})

    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "group string, value double, low double, high double, stderr double, n long"
    return counts.groupBy(*keys, "group").applyInPandas(run, schema)


def accumulated(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(keys, a column for each metric): a list of aggregate expressions over each group, whatever they are."""
    return df.groupBy(*keys).agg(*(m.alias(n) for n, m in metrics.items()))


def run_statistics(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, sd, low, high, runs) over runs, NaN and null left out of the numbers."""
    long = runs.unpivot(keys, metrics, "metric", "v")
    v = F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double"))
    return long.groupBy(*keys, "metric").agg(*(F.round(f(v), 6).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("low", F.min), ("high", F.max))), F.count("*").alias("runs"))
