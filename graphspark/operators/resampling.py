"""Resampling of any numbers as partial aggregates: no values on the driver, no cap on how many there are.

A statistic is a function of sums over rows (``Sums``): a mean of a sum and a
count, a correlation of five sums. Of each replicate only its sums travel.

Bootstrap: in replicate b a row counts w times, w drawn from Poisson(1) by a hash
of (seed, row's number, b); sums over (replicate, stratum) are scaled to the
stratum's size, which stands in for resamples of a fixed size (a stratum of which
nothing is drawn keeps its own sums). The draws are whole-number arithmetic, so
any engine can repeat them. The jackknife of BCa intervals takes each row's share
from the total sums.

Permutations: equal values are counted. Blocks of about ``BLOCK_VALUES`` distinct
values are the leaves of a binary tree; the size of the first group is split down
the tree by hypergeometric draws that depend on seed and node only, so a task
draws its own block's part without knowing the others. Signs within pairs are
binomial draws for each distinct gap. New pairings number the rows and pair row i
of one side with row p(i) of the other, p a keyed permutation.

Defined cases: null and NaN values are left out (with their pair); without values
all is null; with one value the limits are it; repeated rows are rows of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .entities import _written
from .knowledge import numbered
from .sampling import PRIME, round_keys

BLOCK_VALUES = 50_000


@dataclass(frozen=True)
class Sums:
    """A statistic: named terms of a row's values, and what their sums make (numbers or columns alike)."""

    terms: dict[str, Callable[..., Column]]
    finish: Callable[[dict], object]


MEAN = Sums({"t": lambda v: v, "n": lambda v: F.lit(1.0)}, lambda s: s["t"] / s["n"])
VARIANCE = Sums({"q": lambda v: v * v, "t": lambda v: v, "n": lambda v: F.lit(1.0)}, lambda s: s["q"] / s["n"] - (s["t"] / s["n"]) * (s["t"] / s["n"]))
RATIO = Sums({"a": lambda a, b: a, "b": lambda a, b: b}, lambda s: s["a"] / s["b"])

#: P(w <= k) of Poisson(1), as thresholds below ``PRIME``.
POISSON = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def _constants(seed: int) -> tuple[int, ...]:
    return tuple(x for k in round_keys(seed, 2) for x in k)


def with_weight(df: DataFrame, row: str, replicate: str, seed: int, out: str = "w") -> DataFrame:
    """Add how often a row (its column ``row`` is a whole number from 0) counts in a replicate; in steps, so no step is written out twice."""
    c, a, b, d, e, f, g, h, *_ = _constants(seed)
    mixed = lambda u: (F.col(u) * F.col(u) % PRIME * e + F.col(u) * f) % PRIME
    x = (F.col(row) % PRIME + c) % PRIME * a % PRIME
    y = (F.col(replicate) + d) % PRIME * b % PRIME
    steps = df.withColumn("_t", (x + y + F.floor(F.col(row) / PRIME).cast("long") % PRIME * g) % PRIME).withColumn("_u", (mixed("_t") + h) % PRIME)
    steps = steps.withColumn("_t", (F.col("_u") * F.col("_u") % PRIME * a + F.col("_u") * b) % PRIME)
    w = sum(((F.col("_t") >= k).cast("int") for k in POISSON[1:]), (F.col("_t") >= POISSON[0]).cast("int"))
    return steps.withColumn(out, w).drop("_t", "_u")


def weight_sql(row: str, replicate: str, seed: int) -> str:
    """The same in SQL for another engine."""
    c, a, b, d, e, f, g, h, *_ = _constants(seed)
    x, y = f"(({row} % {PRIME} + {c}) % {PRIME} * {a} % {PRIME})", f"(({replicate} + {d}) % {PRIME} * {b} % {PRIME})"
    step = lambda v, body: f"list_transform({v}, lambda x: {body})"
    t = f"[({x} + {y} + {row} // {PRIME} % {PRIME} * {g}) % {PRIME}]"
    u = step(t, f"((x * x % {PRIME} * {e} + x * {f}) % {PRIME} + {h}) % {PRIME}")
    u = step(u, f"(x * x % {PRIME} * {a} + x * {b}) % {PRIME}")
    return step(u, " + ".join(f"(x >= {k})::INT" for k in POISSON)) + "[1]"


def _clean(values: list[Column], *more: Column) -> list[Column]:
    null = F.lit(None).cast("double")
    return [F.nanvl(v.cast("double"), null).alias(f"v{k}") for k, v in enumerate(values)] + list(more)


def replicates_of(df: DataFrame, values: list[Column], row: Column, stratum: Column | None, statistic: Sums, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(stratum sums of the rows themselves, (b, value) of each replicate); ``row`` numbers the rows."""
    names = [f"s{k}" for k in range(len(statistic.terms))]
    rows = df.select(*_clean(values, row.cast("long").alias("row"), (F.lit(0) if stratum is None else stratum).alias("stratum"))).dropna(subset=[f"v{k}" for k in range(len(values))] + ["row"])
    own = [f(*(F.col(f"v{k}") for k in range(len(values)))).alias(n) for n, f in zip(names, statistic.terms.values())]
    terms = rows.select("row", "stratum", *own)
    sizes = _written(terms.groupBy("stratum").agg(F.count("*").cast("double").alias("rows"), *(F.sum(n).alias(n) for n in names)), "strata")
    each = with_weight(terms.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))), "row", "b", seed)
    drawn = each.groupBy("b", "stratum").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(n)).alias(n) for n in names)).where("w > 0")
    # a stratum of which a replicate has nothing keeps its own sums, so strata's own sums are where the total starts
    s = sizes.select(F.col("stratum").alias("_s"), "rows", *(F.col(n).alias(f"_{n}") for n in names))
    joined = drawn.join(s, F.col("stratum").eqNullSafe(F.col("_s")))
    change = joined.groupBy("b").agg(*(F.sum(F.col(n) * F.col("rows") / F.col("w") - F.col(f"_{n}")).alias(n) for n in names))
    total = sizes.agg(*(F.sum(n).alias(n) for n in names)).first()
    every = df.sparkSession.range(replicates).select(F.col("id").alias("b")).join(change, "b", "left")
    summed = {k: F.coalesce(F.col(n), F.lit(0.0)) + F.lit(total[n]).cast("double") for k, n in zip(statistic.terms, names)}
    return sizes, every.select("b", statistic.finish(summed).alias("value"))


def _limits(draws: np.ndarray, seen: float, method: str, alternative: str, level: float, jackknife: tuple[float, float]) -> tuple[float, float]:
    alpha = (1 - level) / 2 if alternative == "two-sided" else 1 - level
    low, high = alpha, 1 - alpha
    if method == "bca":
        normal, n = NormalDist(), len(draws)
        share = min(max(((draws < seen).sum() + (draws == seen).sum() / 2) / n, 0.5 / n), 1 - 0.5 / n)
        z0 = normal.inv_cdf(share)
        squares, cubes = jackknife
        a = cubes / (6 * squares**1.5) if squares > 0 else 0.0
        low, high = (normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in map(normal.inv_cdf, (low, high)))
    limits = np.quantile(draws, [low, high])
    if method == "basic":
        limits = 2 * seen - limits[::-1]
    return -math.inf if alternative == "less" else float(limits[0]), math.inf if alternative == "greater" else float(limits[1])


def bootstrap(df: DataFrame, values: list[Column], row: Column | None = None, stratum: Column | None = None, statistic: Sums = MEAN, method: str = "bca", alternative: str = "two-sided", replicates: int = 999, level: float = 0.9, seed: int = 1) -> DataFrame:
    """One row: value, low, high, stderr, n of a statistic, resampled within strata.

    ``row`` numbers the rows; without it they are numbered by a sort of their values, so equal inputs give equal draws.
    method: "bca", "percentile" or "basic"; alternative: "two-sided", "less" or "greater". One number for each replicate
    reaches the driver.
    """
    spark = df.sparkSession
    if row is None:
        kept = df.select(*_clean(values, (F.lit(0) if stratum is None else stratum).alias("stratum")), F.lit(0).alias("_all"))
        names = [f"v{k}" for k in range(len(values))]
        kept = kept.dropna(subset=names)
        # equal rows are told apart by a number that any order of theirs gives alike
        df = numbered(_written(kept.withColumn("_at", F.monotonically_increasing_id()), "rows"), "_all", ["stratum", *names, "_at"], "row")
        values, row, stratum = [F.col(n) for n in names], F.col("row") - 1, F.col("stratum")
    sizes, drawn = replicates_of(df, values, row, stratum, statistic, replicates, seed)
    sums = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0.0)).alias("rows"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(len(statistic.terms)))).first()
    total = {name: sums[f"s{k}"] for k, name in enumerate(statistic.terms)}
    n = int(sums.rows)
    if not n:
        return spark.range(1).select(*(F.lit(None).cast("double").alias(x) for x in ("value", "low", "high", "stderr")), F.lit(0).cast("long").alias("n"))
    seen = statistic.finish(total)
    draws = np.sort(drawn.toPandas().value.dropna().to_numpy())
    jackknife = (0.0, 0.0)
    if method == "bca" and n > 1:
        rows = df.select(*_clean(values)).dropna()
        left = statistic.finish({k: F.lit(total[k]) - f(*(F.col(f"v{j}") for j in range(len(values)))) for k, f in statistic.terms.items()})
        away = rows.select((F.lit(seen) - left).alias("d"))  # near zero, so its powers lose no digits
        m = away.agg(*(F.avg(F.pow("d", F.lit(p))).alias(f"m{p}") for p in (1, 2, 3)), F.count("d").alias("k")).first()
        if m.k:
            squares = m.m2 - m.m1**2
            jackknife = (m.k * squares, m.k * (m.m3 - 3 * m.m1 * m.m2 + 2 * m.m1**3))
    low, high = _limits(draws, seen, method, alternative, level, jackknife)
    stderr = float(draws.std(ddof=1)) if len(draws) > 1 else 0.0
    return spark.createDataFrame([(float(seen), low, high, stderr, n)], "value double, low double, high double, stderr double, n long")


# --------------------------------------------------------------------------
# Permutations


def _blocks(counted: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """Counted values with ``block``, and the number of blocks, a power of two."""
    blocks = 1 << max(0, math.ceil(math.log2(max(1, counted.count()) / BLOCK_VALUES)))
    return counted.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")), blocks


def _split(sizes: np.ndarray, block: int, first: int, replicates: int, seed: int) -> np.ndarray:
    """For each replicate, how many of ``first`` drawn rows fall in a block, down a tree over the blocks' sizes."""
    low, high, drawn = 0, len(sizes), np.full(replicates, first, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left, right = int(sizes[low:mid].sum()), int(sizes[mid:high].sum())
        rng = np.random.default_rng([seed, low, high])
        mine = rng.hypergeometric(left, right, drawn) if left and right else np.where(left > 0, drawn, 0)
        low, high, drawn = (low, mid, mine) if block < mid else (mid, high, drawn - mine)
    return drawn


def _summed(blocks: DataFrame, draw: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """(b, s): each block's sums of all replicates, added up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = draw(pdf)
        return pd.DataFrame({"b": np.arange(len(s)), "s": s})

    return blocks.groupBy("block").applyInPandas(run, "b long, s double").groupBy("b").agg(F.sum("s").alias("s"))


def _extreme(value: Column, seen: float, alternative: str) -> Column:
    """Ties within 100 units of rounding count as extreme."""
    near = abs(seen) * 100 * float(np.finfo(float).eps)
    if alternative == "greater":
        return value >= seen - near
    if alternative == "less":
        return value <= seen + near
    return F.abs(value) >= abs(seen) - near


def _share(spark, seen: float, drawn: DataFrame, alternative: str) -> DataFrame:
    hits = drawn.select(_extreme(F.col("value"), seen, alternative).alias("e"))
    return hits.agg(F.lit(seen).alias("statistic"), ((F.count_if("e") + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("permutations"), F.lit(False).alias("exact"))


def _whole(spark, seen: float, every: list[float], alternative: str) -> DataFrame:
    near, x = abs(seen) * 100 * np.finfo(float).eps, np.array(every)
    hits = np.abs(x) >= abs(seen) - near if alternative == "two-sided" else x >= seen - near if alternative == "greater" else x <= seen + near
    return spark.createDataFrame([(seen, float(hits.mean()), len(x), True)], "statistic double, p double, permutations long, exact boolean")


def _nothing(spark) -> DataFrame:
    return spark.range(1).select(*(F.lit(None).cast("double").alias(x) for x in ("statistic", "p")), F.lit(0).cast("long").alias("permutations"), F.lit(False).alias("exact"))


def _independent(df: DataFrame, value: Column, by: Column, alternative: str, replicates: int, seed: int) -> DataFrame:
    spark = df.sparkSession
    rows = df.select(*_clean([value], by.cast("boolean").alias("g"))).dropna()
    counted = _written(rows.groupBy("v0").agg(F.count("*").alias("n"), F.count_if("g").alias("own")), "counted")
    t = counted.agg(F.sum("n").alias("n"), F.sum("own").alias("n1"), F.sum(F.col("v0") * F.col("n")).alias("s"), F.sum(F.col("v0") * F.col("own")).alias("s1")).first()
    n, n1 = t.n or 0, t.n1 or 0
    if not n1 or n1 == n:
        return _nothing(spark)
    difference = lambda s1: s1 / n1 - (t.s - s1) / (n - n1)
    seen = difference(t.s1)
    if n <= replicates and math.comb(n, n1) <= replicates:  # few values, then
        values = [r.v0 for r in counted.orderBy("v0").collect() for _ in range(r.n)]
        return _whole(spark, seen, [difference(sum(c)) for c in itertools.combinations(values, n1)], alternative)
    blocks, many = _blocks(counted, ["v0"])
    sizes = np.zeros(many, np.int64)
    for r in blocks.groupBy("block").agg(F.sum("n").alias("n")).collect():  # a number for each block
        sizes[r.block] = r.n

    def draw(pdf: pd.DataFrame) -> np.ndarray:
        pdf, block = pdf.sort_values("v0"), int(pdf.block.iloc[0])
        v, n = pdf.v0.to_numpy(), pdf.n.to_numpy(np.int64)
        rng = np.random.default_rng([seed, block, 1 << 40])
        return np.array([float(v @ rng.multivariate_hypergeometric(n, int(m), method="marginals")) for m in _split(sizes, block, n1, replicates, seed)])

    drawn = _summed(blocks, draw)
    return _share(spark, seen, drawn.select(difference(F.col("s")).alias("value")), alternative)


def _samples(df: DataFrame, value: Column, by: Column, alternative: str, replicates: int, seed: int) -> DataFrame:
    spark = df.sparkSession
    gaps = df.select(*_clean([value, by])).dropna().select((F.col("v0") - F.col("v1")).alias("gap"))
    counted = _written(gaps.groupBy("gap").agg(F.count("*").alias("n")), "counted")
    t = counted.agg(F.sum("n").alias("n"), F.sum(F.col("gap") * F.col("n")).alias("s")).first()
    n = t.n or 0
    if n < 2:
        return _nothing(spark)
    seen = t.s / n
    if n < 40 and 2**n <= replicates:
        values = np.array([r.gap for r in counted.orderBy("gap").collect() for _ in range(r.n)])
        return _whole(spark, seen, [float((values * np.array(s)).mean()) for s in itertools.product((1, -1), repeat=n)], alternative)
    blocks, _ = _blocks(counted, ["gap"])

    def draw(pdf: pd.DataFrame) -> np.ndarray:
        pdf = pdf.sort_values("gap")
        gap, k = pdf.gap.to_numpy(), pdf.n.to_numpy(np.int64)
        rng = np.random.default_rng([seed, int(pdf.block.iloc[0])])
        return np.array([float(gap @ (2 * rng.binomial(k, 0.5) - k)) for _ in range(replicates)])

    return _share(spark, seen, _summed(blocks, draw).select((F.col("s") / n).alias("value")), alternative)


def _shuffled(i: Column, n: int, replicate: Column, seed: int) -> Column:
    """Where number i below n goes in a replicate's permutation: walks of a pair permutation until it is below n again."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    key = lambda r, c: 1 + F.pmod(F.xxhash64(F.lit(seed), replicate, r, F.lit(c)), F.lit(PRIME - 1))
    rounds = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda r: F.struct(*(key(r, c).alias(c) for c in "cab")))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("i"), (x % b).cast("long").alias("j"), F.lit(a).cast("long").alias("n"), F.lit(b).cast("long").alias("m"))

        def step(s: Column, k: Column) -> Column:
            t = (s["j"] + k["c"]) % PRIME
            return F.struct(s["j"].alias("i"), ((s["i"] + (t * t % PRIME * k["a"] + k["b"]) % PRIME) % s["n"]).alias("j"), s["m"].alias("n"), s["n"].alias("m"))

        return F.aggregate(rounds, start, step, lambda s: s["i"] * b + s["j"])

    # fewer than a numbers are not below n, and a walk leaves them after so many steps; beyond 64 its odds are below a**-64
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(a, 64))), once(i), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def _pairings(df: DataFrame, value: Column, by: Column, alternative: str, replicates: int, seed: int) -> DataFrame:
    spark = df.sparkSession
    rows = df.select(*_clean([value, by])).dropna()
    m = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in ("v0", "v1") for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n = m.n
    if n < 2:
        return _nothing(spark)
    scaled = rows.select(((F.col("v0") - m.mv0) / (m.sv0 or 1.0)).alias("x"), ((F.col("v1") - m.mv1) / (m.sv1 or 1.0)).alias("y"))
    seen = scaled.agg(F.avg(F.col("x") * F.col("y"))).first()[0]
    if n < 12 and math.factorial(n) <= replicates:
        x, y = np.array([(r.x, r.y) for r in scaled.orderBy("x", "y").collect()]).T
        return _whole(spark, seen, [float((x * y[list(at)]).mean()) for at in itertools.permutations(range(n))], alternative)
    at = _written(numbered(_written(scaled.select("x", "y", F.lit(0).alias("_all"), F.monotonically_increasing_id().alias("_at")), "pairs"), "_all", ["x", "y", "_at"], "i"), "pairs")
    left = at.select((F.col("i") - 1).alias("i"), "x").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    moved = left.select("b", "x", _shuffled(F.col("i"), n, F.col("b"), seed).alias("j"))
    drawn = moved.join(at.select((F.col("i") - 1).alias("j"), "y"), "j").groupBy("b").agg((F.sum(F.col("x") * F.col("y")) / n).alias("value"))
    return _share(spark, seen, drawn, alternative)


def permutation(df: DataFrame, value: Column, by: Column, kind: str = "independent", alternative: str = "two-sided", replicates: int = 9999, seed: int = 3) -> DataFrame:
    """One row: a statistic, its p, how many permutations were looked at, and whether these are all.

    "independent": ``by`` parts the values in two groups, the statistic is the difference of their means. "samples":
    ``value`` and ``by`` are paired numbers, which change places within pairs; the mean difference. "pairings": they are
    paired anew; the correlation (each replicate joins the rows once). All permutations are looked at where they are no
    more than ``replicates``; then p is their share, else (hits + 1) / (replicates + 1).
    """
    return {"independent": _independent, "samples": _samples, "pairings": _pairings}[kind](df, value, by, alternative, replicates, seed)


def monte_carlo(df: DataFrame, value: Column, draw: Callable[[np.random.Generator, int], np.ndarray], statistic: Sums = MEAN, alternative: str = "greater", replicates: int = 9999, seed: int = 5) -> DataFrame:
    """One row: the statistic and how often one of as many values drawn by ``draw(rng, n)`` is as extreme; (hits + 1) / (replicates + 1).

    Values are drawn ``BLOCK_VALUES`` at a time, wherever a task is free; a replicate is the sums of its parts.
    """
    spark, names = df.sparkSession, [f"s{k}" for k in range(len(statistic.terms))]
    rows = df.select(*_clean([value])).dropna()
    own = [f(F.col("v0")).alias(n) for n, f in zip(names, statistic.terms.values())]
    t = rows.select(*own).agg(F.count("*").alias("_rows"), *(F.sum(n).alias(n) for n in names)).first()
    n = t["_rows"]
    if not n:
        return spark.range(1).select(F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("p"))
    seen = float(statistic.finish({k: t[n] for k, n in zip(statistic.terms, names)}))
    parts = -(-n // BLOCK_VALUES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in pdf.id.tolist():
                b, part = divmod(at, parts)
                x = draw(np.random.default_rng([seed, b, part]), min(BLOCK_VALUES, n - part * BLOCK_VALUES))
                yield pd.DataFrame({"b": b, "v0": np.asarray(x, float)})

    drawn = spark.range(replicates * parts).mapInPandas(run, "b long, v0 double").select("b", *own).groupBy("b").agg(*(F.sum(k).alias(k) for k in names))
    hits = drawn.select(_extreme(statistic.finish({k: F.col(n) for k, n in zip(statistic.terms, names)}), seen, alternative).alias("e"))
    return hits.agg(F.lit(seen).alias("value"), ((F.count_if("e") + 1) / (F.count("*") + 1)).alias("p"))
