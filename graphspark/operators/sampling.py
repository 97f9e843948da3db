"""Draws without replacement from the pairs of two tables, by a keyed permutation of the pairs' numbers.

Pair number r of n x m pairs is (r div m, r mod m). An unbalanced Feistel network
adds to one half, modulo its size, a keyed hash of the other half, and swaps
halves; each round can be undone, so an even number of rounds permutes the pairs.
Draw r is the pair at the permuted number: draws 0, 1, 2, ... are distinct pairs
in an order that looks random, and any task can compute any range of them. No
cross product is built, and nothing is drawn on the driver.

Defined cases: null ids are no ids, repeated ids count once; where fewer pairs
are free than asked for, all of them come; empty tables give no pairs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .entities import _written
from .knowledge import numbered

#: Hashes are taken modulo this prime, so that products fit in 64 bits.
PRIME = 2_147_483_647
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int, int]]:
    """Five constants below ``PRIME`` for each round."""
    words = lambda k: hashlib.sha256(f"{seed}:{k}".encode()).digest()
    return [tuple(1 + int.from_bytes(words(k)[at : at + 6], "big") % (PRIME - 1) for at in range(0, 30, 6)) for k in range(rounds)]


def _hash(x: Column, k: Column) -> Column:
    """62 bits of a quadratic hash of x."""
    t = (x + k["c"]) % PRIME
    square = t * t % PRIME
    return (square * k["a"] + k["b"]) % PRIME * PRIME + (square * k["d"] + k["e"]) % PRIME


def permuted(number: Column, n: Column, m: Column, seed: int) -> Column:
    """The pair (i, j), i below n and j below m, at a number below n * m: one for each number, and each once."""
    keys = F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(key, "cabde"))) for key in round_keys(seed)))
    long = lambda c: c.cast("long")
    start = F.struct(long(F.floor(number / m)).alias("i"), long(number % m).alias("j"), long(n).alias("n"), long(m).alias("m"))
    step = lambda s, k: F.struct(s["j"].alias("i"), ((s["i"] + _hash(s["j"], k)) % s["n"]).alias("j"), s["m"].alias("n"), s["n"].alias("m"))
    return F.aggregate(keys, start, step)


def permuted_sql(source: str, seed: int) -> str:
    """CTEs p0, p1, ... that permute rows (r, i, j, n, m) of ``source`` for another engine; the last is p6."""
    out, before = [], source
    for k, (c, a, b, d, e) in enumerate(round_keys(seed)):
        t = f"((j + {c}) % {PRIME})"
        out.append(
            f"p{k + 1} AS (SELECT r, j AS i, (i + ({t} * {t} % {PRIME} * {a} + {b}) % {PRIME} * {PRIME} + ({t} * {t} % {PRIME} * {d} + {e}) % {PRIME}) % n AS j, m AS n, n AS m FROM {before})"
        )
        before = f"p{k + 1}"
    return ", ".join(out)


def nth_smallest(rows: DataFrame, column: str, n: int, low: int, high: int, bins: int = 4096) -> int | None:
    """The n-th smallest (from 1) of whole numbers in [low, high), by histograms of ever smaller ranges; None where there are fewer."""
    while True:
        width = (high - low + bins - 1) // bins
        inside = rows.where((F.col(column) >= low) & (F.col(column) < high))
        counts = inside.groupBy(F.floor((F.col(column) - low) / width).alias("bin")).count().orderBy("bin").collect()  # ``bins`` rows at most
        for r in counts:
            if n <= r["count"]:
                break
            n -= r["count"]
        else:
            return None
        if width <= 1:
            return low + r.bin
        low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width)


def _dense(ids: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): distinct ids numbered from 0 in their order, over ranges of a sort."""
    one = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_all", F.lit(0))
    return _written(numbered(one, "_all", [column], out).select(column, (F.col(out) - 1).alias(out)), "dense")


def negative_pairs(left: DataFrame, right: DataFrame, used: DataFrame, n: int, seed: int = 0, most_rejects: int | None = None, at_once: int | None = None) -> DataFrame:
    """(draw, left id, right id): the first ``n`` drawn pairs that are not in ``used``.

    ``left`` and ``right`` have one column of ids each, ``used`` both. Drawing
    stops before the ``most_rejects``-th rejected pair, or where all pairs are
    drawn. Only drawn pairs are looked up; each turn draws as many as all before.
    """
    a, b = left.columns[0], right.columns[0]
    spark, rows, columns = left.sparkSession, _dense(left, a, "_i"), _dense(right, b, "_j")
    n_left, n_right = rows.count(), columns.count()
    size, drawn, turns, taken, rejected = n_left * n_right, 0, [], 0, 0
    taken_pairs = used.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct().withColumn("_used", F.lit(True))
    most = min(size, max(at_once or 1000, n + n // 8))
    while drawn < size and taken < n and (most_rejects is None or rejected < most_rejects):
        numbers = spark.range(drawn, most).withColumnRenamed("id", "draw")
        at = numbers.select("draw", permuted(F.col("draw"), F.lit(n_left), F.lit(n_right), seed).alias("p")).select("draw", F.col("p.i").alias("_i"), F.col("p.j").alias("_j"))
        pairs = at.join(rows, "_i").join(columns, "_j").join(taken_pairs, [a, b], "left")
        turns.append(_written(pairs.select("draw", a, b, F.col("_used").isNotNull().alias("_used")), "draws"))
        counts = turns[-1].agg(F.count_if("_used").alias("r"), F.count_if(~F.col("_used")).alias("t")).first()
        taken, rejected, drawn, most = taken + counts.t, rejected + counts.r, most, min(size, 2 * most)
    if not turns:
        return left.select(F.lit(0).cast("long").alias("draw"), a).join(right.select(b), F.lit(False)).limit(0)
    found = turns[0]
    for t in turns[1:]:
        found = found.unionAll(t)
    ends = [drawn]
    if taken > n:
        ends.append(nth_smallest(found.where("NOT _used"), "draw", n + 1, 0, drawn))
    if most_rejects is not None and rejected >= most_rejects:
        ends.append(nth_smallest(found.where("_used"), "draw", most_rejects, 0, drawn))
    return found.where(~F.col("_used") & (F.col("draw") < min(ends))).select("draw", a, b)
