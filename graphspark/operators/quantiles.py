"""Exact quantiles of all groups at once, by histograms that narrow.

Values of a group are counted (the key of that shuffle is group and value, so a
hot group is spread). A group with up to ``few`` distinct values is sorted where
it stands. In each larger group every rank asked for has an interval that holds
it; a pass counts the group's values in ``bins`` bins of the interval, with each
bin's least and greatest value and partial sums before the shuffle, and goes on
with the bin that holds the rank. Values meet intervals by group and a part of
the value's hash, never a whole group in one task. Passes end when an interval
holds up to ``few`` distinct values: two or three as a rule, since each divides
the interval by ``bins``.

A rank p gives linear interpolation at p * (n - 1), as SQL's percentile_cont.

Defined cases: null and NaN values are left out; groups without values are too;
a null key is a group; infinite values are least or greatest, and interpolating
between them and others gives them; equal values count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .entities import _written

#: Distinct values of a group, or of an interval, that one task sorts.
FEW = 10_000
BINS = 1024
#: Parts in which a large group's values are dealt.
PARTS = 64


def _same(a: DataFrame, b: DataFrame, keys: list[str], *more: str) -> Column:
    """Equal keys, null keys too; ``b`` has them with an underscore before."""
    found = F.lit(True)
    for k in keys:
        found = found & a[k].eqNullSafe(b[f"_{k}"])
    for c in more:
        found = found & (a[c] == b[f"_{c}"])
    return found


def _prefixed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in names})


def _dealt(table: DataFrame, parts: int) -> DataFrame:
    """The table once for each part, with ``part``: a few rows for each large group."""
    return table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def _ranked(values: DataFrame, by: list[str], below: Column) -> DataFrame:
    """Counted values with ``first`` and ``last``, the ranks (from 0) that each takes; ``below`` values stand before the group's."""
    order = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("last", F.sum("_n").over(order) + below - 1).withColumn("first", F.col("last") - F.col("_n") + 1)


def _narrowed(values: DataFrame, wanted: DataFrame, keys: list[str], bins: int, parts: int) -> DataFrame:
    """Intervals (keys, rank, lo, hi, below, distinct), each narrowed to the bin that holds its rank."""
    by = [*keys, "rank"]
    w = _prefixed(_dealt(wanted, parts), [*keys, "part"])
    inside = values.join(w, _same(values, w, keys, "part") & F.col("_v").between(F.col("lo"), F.col("hi")))
    # halves don't overflow; where they are too small to differ, the values themselves are used
    half = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    place = F.when(F.col("_v") == F.col("lo"), 0.0).when(F.col("_v") == F.col("hi"), 1.0).when(F.col("hi") - F.col("lo") == math.inf, half)
    share = place.otherwise((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    bin_ = F.least(F.floor(F.nanvl(share, F.lit(0.5)) * bins), F.lit(bins - 1))
    counts = inside.select(*(F.col(k) for k in keys), "rank", "below", bin_.alias("bin"), "_v", "_n").groupBy(*by, "below", "bin").agg(
        F.sum("_n").alias("n"), F.count("*").alias("distinct"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    order = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum("n").over(order), F.lit(0))
    placed = counts.withColumn("start", start).where((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("n")))
    return placed.select(*by, "lo", "hi", F.col("start").alias("below"), "distinct")


def order_statistics(values: DataFrame, wanted: DataFrame, keys: list[str], few: int = FEW, bins: int = BINS, parts: int = PARTS) -> DataFrame:
    """(keys, rank, value) of the ranks in ``wanted`` (keys, rank from 0, lo, hi, below, distinct) of counted values (keys, _v, _n, part)."""
    done, now = [], _written(wanted, "ranks")
    while True:
        single, last = F.col("lo") == F.col("hi"), F.col("distinct") <= few
        done.append(now.where(single).select(*keys, "rank", F.col("lo").alias("value")))
        w = _prefixed(_dealt(now.where(~single & last), parts), [*keys, "part"])
        inside = values.join(w, _same(values, w, keys, "part") & F.col("_v").between(F.col("lo"), F.col("hi")))
        ranked = _ranked(inside.select(*keys, "rank", "below", "_v", "_n"), [*keys, "rank"], F.col("below"))
        done.append(ranked.where("first <= rank AND rank <= last").select(*keys, "rank", F.col("_v").alias("value")))
        rest = now.where(~single & ~last)
        if not rest.limit(1).count():
            break
        now = _written(_narrowed(values, rest, keys, bins, parts), "ranks")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def group_quantiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float], few: int = FEW, bins: int = BINS, parts: int = PARTS) -> DataFrame:
    """(keys, n, a column for each of ``shares``): exact quantiles of a number in each group, interpolated between ranks."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double")) + F.lit(0.0)  # -0.0 is 0.0
    counted = df.select(*keys, v.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    values = _written(counted.withColumn("part", F.pmod(F.xxhash64("_v"), F.lit(parts)).cast("int")), "counted-values")
    sizes = _written(values.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("distinct"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0"), "group-sizes")
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in shares.values()))))
    large = sizes.where(F.col("distinct") > few)
    small, big = values, None
    if large.limit(1).count():
        wanted = large.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "distinct")
        big = order_statistics(values, wanted, keys, few, bins, parts)
        # the other groups are sorted whole; large ones are kept out by their parts
        large_keys = _prefixed(_dealt(large.select(*keys), parts), [*keys, "part"])
        small = values.join(large_keys, _same(values, large_keys, keys, "part"), "left_anti") if keys else values.limit(0)
    ranked = _ranked(small, keys, F.lit(0)) if keys else _ranked(small.withColumn("_all", F.lit(0)), ["_all"], F.lit(0)).drop("_all")
    s = _prefixed(sizes.where(F.col("distinct") <= few).select(*keys, F.explode(ranks).alias("rank")), keys)
    few_values = ranked.join(s, _same(ranked, s, keys) & F.col("rank").between(F.col("first"), F.col("last"))).select(*keys, "rank", F.col("_v").alias("value"))
    every = few_values if big is None else big.unionAll(few_values)
    found = _prefixed(every.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")), keys)
    joined = sizes.join(found, _same(sizes, found, keys))

    def interpolated(p: float) -> Column:
        low, high = F.col("_at")[F.floor(at(p))], F.col("_at")[F.ceil(at(p))]
        return F.when(low == high, low).otherwise(low + (high - low) * (at(p) - F.floor(at(p))))

    return joined.select(*(sizes[k] for k in keys), "n", *(interpolated(p).alias(c) for c, p in shares.items()))
