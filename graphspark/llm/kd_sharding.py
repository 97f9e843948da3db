"""Sharding by a k-d tree over metadata: leaves of equal bytes.

A node of the tree that is to hold k shards is cut along its widest dimension
(its range over the whole table's range) where the left side has k//2 of k parts
of its bytes: a weighted median, found for all nodes of a level at once by
histograms that Spark sums and that narrow down to few rows. Rows are ordered by
the dimension, then by the hash of the text (so equal texts stay together unless
a cut has to fall between them), then by a row number written beforehand. Rows
next to a cut, with a text of their own, may change sides to even out its bytes.

The table carries its rows' nodes in a column that each level writes anew; what
the driver finds goes back as a small table, one row for each node of the level,
so plans and generated code are of one size at every depth. The driver holds at
most ``LEVEL_ROWS`` histogram bins, and as many rows next to cuts, for a level.

Defined cases: null texts count as empty; null and NaN dimensions come first; strings
count by the place of the whole string among the distinct ones; repeated rows
are rows of their own; an empty table gives no rows; shards beyond the number of
rows stay empty; of the caller's columns only those of ``keep`` are returned.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, documents, drop

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Bins of a node's histogram and rows around a cut that are looked at one by one; rows that may change sides.
BINS, NEAR_ROWS, MOVES = 1024, 1024, 12
#: Bins, and rows around cuts, of a whole level on the driver (16 for each node at least).
LEVEL_ROWS = 1 << 20
#: Parts that the copies of one text are dealt in.
SALTS = 64
_HASH_BITS, _DIM_BITS = 41, 21


@dataclass
class Node:
    """A node that holds ``shards`` shards from ``first`` on, and while it is cut: where to look for the cut."""

    number: int
    shards: int
    first: int
    dim: int = 0
    low: int = 0
    high: int = 0
    want: float = 0.0  # bytes left of the cut
    below: int = 0  # bytes left of ``low``
    tie: bool = False  # the cut falls among rows of the key ``fixed``
    fixed: int = 0
    few: bool = False

    def narrow(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, rows: np.ndarray, near: int) -> None:
        """low, high, size, rows of this node's bins in order: keep the bin that the cut falls in, and bins after it while rows are few."""
        reached = np.flatnonzero(self.below + np.cumsum(size) >= self.want)
        at = int(reached[0]) if len(reached) else len(size) - 1
        self.below += int(size[:at].sum())
        inside = np.cumsum(rows[at:])
        last = at + max(0, int(np.searchsorted(inside, near, side="right")) - 1)
        self.low, self.high = int(low[at]), int(high[last]) + 1
        self.few = int(rows[at : last + 1].sum()) <= near
        if not self.few and self.high - self.low == 1:
            self.tie, self.fixed, self.low, self.high = True, self.low, 0, 1 << 62


def _table(spark: SparkSession, rows: Iterable[dict], schema: pa.Schema) -> DataFrame:
    """A table of one row for each node of a level: its bound is the number of shards."""
    return F.broadcast(spark.createDataFrame(pa.Table.from_pylist(list(rows), schema)))


_LOOK = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("step", pa.int64()), ("tie", pa.bool_()), ("fixed", pa.int64())])
_CUTS = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("moved", pa.list_(pa.int64())), ("left", pa.int64()), ("right", pa.int64())])


def _choose(rows: list[tuple[int, int, int]], deficit: float) -> tuple[int, int, list[int]]:
    """rows: (key, uid, bytes) in order. The cut and the rows to move so that about ``deficit`` bytes are left of it."""
    best, total = 0, 0
    for n, (_, _, size) in enumerate(rows, 1):
        if total + size > deficit:
            break
        best, total = n, total + size
    # moves even out the rest, from the largest that fits
    shared = {k for (k, *_), (j, *_) in zip(rows, rows[1:]) if k == j}
    moved: list[int] = []
    rest = deficit - total
    for size, uid in sorted(((s, u) for k, u, s in rows[best + 1 :] if k not in shared), reverse=True):
        if size <= rest and len(moved) < MOVES:
            moved.append(uid)
            rest -= size
    if best < len(rows):
        key, uid, size = rows[best]
        if size - (deficit - total) < rest:  # nearer with one row more
            best, moved = best + 1, []
        if best < len(rows):
            return rows[best][0], rows[best][1], moved
    last = rows[-1] if rows else (0, 0, 0)
    return last[0], last[1] + 1, moved


def _by_node(table: pa.Table, *order: str) -> dict[int, dict[str, np.ndarray]]:
    """A collected table's columns for each node, rows in the given order."""
    columns = {c: table[c].to_numpy() for c in table.column_names}
    sort = np.lexsort([columns[c] for c in (*reversed(order), "node")])
    columns = {c: v[sort] for c, v in columns.items()}
    nodes, first = np.unique(columns["node"], return_index=True)
    ends = [*first[1:].tolist(), len(sort)]
    return {int(n): {c: v[a:b] for c, v in columns.items()} for n, a, b in zip(nodes, first.tolist(), ends)}


def _cuts(meta: DataFrame, nodes: list[Node], dims: int) -> list[dict]:
    """The cuts of all nodes of a level: histograms narrow the key's range, then the row number's, then rows decide."""
    spark = meta.sparkSession
    share = max(16, LEVEL_ROWS // len(nodes))
    bins, near = min(BINS, share), min(NEAR_ROWS, share)
    spread = lambda d: F.shiftright(f"k{d}", _HASH_BITS)
    stats = meta.groupBy("node").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("n"),
        *(f(v).alias(f"{name}{d}") for d in range(dims) for name, f, v in (("w", F.max, spread(d)), ("v", F.min, spread(d)), ("hi", F.max, f"k{d}"), ("lo", F.min, f"k{d}"))),
    )
    found = {r["node"]: r for r in stats.toArrow().to_pylist()}
    live = [n for n in nodes if n.number in found]  # a node without rows: its shards stay empty
    for n in live:
        r = found[n.number]
        n.dim = max(range(dims), key=lambda d: (r[f"w{d}"] - r[f"v{d}"], -d))
        n.low, n.high = r[f"lo{n.dim}"], r[f"hi{n.dim}"] + 1
        n.want, n.few = r["bytes"] * (n.shards // 2) / n.shards, r["n"] <= near

    def inside(of: list[Node]) -> DataFrame:
        look = ({**vars(n), "node": n.number, "step": -(-(n.high - n.low) // bins)} for n in of)
        rows = meta.join(_table(spark, ({c: r[c] for c in _LOOK.names} for r in look), _LOOK), "node")
        rows = rows.withColumn("key", F.get(F.array(*(f"k{d}" for d in range(dims))), F.col("dim")))
        rows = rows.withColumn("value", F.when(F.col("tie"), F.col("uid")).otherwise(F.col("key")))
        return rows.where("(NOT tie OR key = fixed) AND value >= low AND value < high")

    while wide := [n for n in live if not n.few]:
        sums = inside(wide).groupBy("node", F.expr("(value - low) div step").alias("bin"))
        sums = sums.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("size").alias("size"), F.count("*").alias("rows"))
        of = {n.number: n for n in wide}
        for number, b in _by_node(sums.toArrow(), "bin").items():
            of[number].narrow(b["low"], b["high"], b["size"], b["rows"], near)
    rows = _by_node(inside(live).select("node", "key", "uid", "size").toArrow(), "key", "uid") if live else {}
    cuts = []
    for n in live:
        b = rows[n.number]
        key, row, moved = _choose(list(zip(b["key"].tolist(), b["uid"].tolist(), b["size"].tolist())), n.want - n.below)
        cuts.append({"node": n.number, "dim": n.dim, "key": key, "row": row, "moved": moved})
    return cuts


def kd_tree(meta: DataFrame, dims: int, shards: int) -> DataFrame:
    """meta: a written table with size, uid and the keys k0, k1, ... The same rows with ``shard``."""
    spark = meta.sparkSession
    placed = meta.withColumn("node", F.lit(0).cast("long"))
    level, done, made, before = [Node(0, shards, 0)], {0: 0}, 1, None
    while level := [n for n in level if n.shards > 1]:
        cuts = {c["node"]: c for c in _cuts(placed, level, dims)}
        children = []
        for n in level:
            half = n.shards // 2
            left, right = Node(made, half, n.first), Node(made + 1, n.shards - half, n.first + half)
            children += [left, right]
            made += 2
            done |= {left.number: left.first, right.number: right.first}
            if n.number in cuts:
                cuts[n.number] |= {"left": left.number, "right": right.number}
        here = placed.join(_table(spark, cuts.values(), _CUTS), "node", "left")
        key = F.get(F.array(*(f"k{d}" for d in range(dims))), F.col("dim"))
        goes = (key < F.col("key")) | ((key == F.col("key")) & (F.col("uid") < F.col("row"))) | F.array_contains("moved", F.col("uid"))
        node = F.when(F.col("key").isNull(), F.col("node")).when(goes, F.col("left")).otherwise(F.col("right"))
        placed = cut(here.select(*meta.columns, node.alias("node")), "kd-nodes")
        if before is not None:
            drop(before)
        level, before = children, placed
    first = _table(spark, ({"node": n, "shard": s} for n, s in done.items()), pa.schema([("node", pa.int64()), ("shard", pa.int32())]))
    return placed.join(first, "node").drop("node")


def slots(df: DataFrame, shard: str = "shard", uid: str = "uid") -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps within a shard, by counts of each writing task's rows.

    uid: a row number from ``monotonically_increasing_id``, unique. Rows of a null shard are not returned; an empty
    table stays empty.
    """
    task = df.withColumn("_task", F.shiftright(uid, 33))
    counts = task.groupBy(shard, "_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(shard, "_task", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(shard, "_task").orderBy(uid)) - 1
    return task.withColumn("_in", inside).join(base, [shard, "_task"]).withColumn("slot", (F.col("_base") + F.col("_in")).cast("long")).drop("_task", "_in", "_base")


def _codes(meta: DataFrame, column: str) -> DataFrame:
    """Replace a string by its place among the distinct strings, as a number; null stays null."""
    values = meta.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct().sort("_v")
    values = cut(values.select("_v", F.monotonically_increasing_id().alias("_id")), "kd-values")
    task = F.shiftright("_id", 33)
    counts = {r["t"]: r["n"] for r in values.groupBy(task.alias("t")).agg(F.count("*").alias("n")).toArrow().to_pylist()}
    before = F.create_map(*(F.lit(x) for t in counts for x in (t, sum(n for u, n in counts.items() if u < t)))) if counts else F.lit(None)
    place = (F.element_at(before, task) if counts else F.lit(0)) + F.col("_id").bitwiseAND((1 << 33) - 1)
    codes = values.select("_v", place.cast("double").alias("_c"))
    return meta.join(codes, meta[column] == codes["_v"], "left").drop(column, "_v").withColumnRenamed("_c", column)


def _same_for_equal_texts(meta: DataFrame, names: list[str]) -> DataFrame:
    """Equal texts take the least metadata of their group. Copies are dealt in ``SALTS`` parts, each with its own row of the group."""
    meta = meta.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    parts = meta.groupBy("text_hash", "_salt").agg(F.count("*").alias("_n"), *(F.min(n).alias(n) for n in names))
    groups = parts.groupBy("text_hash").agg(F.collect_list("_salt").alias("_salts"), F.sum("_n").alias("_n"), *(F.min(n).alias(f"{n}g") for n in names))
    groups = groups.where("_n > 1").select("text_hash", F.explode("_salts").alias("_salt"), F.lit(True).alias("_many"), *(f"{n}g" for n in names))
    joined = meta.join(groups, ["text_hash", "_salt"], "left")
    return joined.select(*(c for c in meta.columns if c not in (*names, "_salt")), *(F.when(F.col("_many"), F.col(f"{n}g")).otherwise(F.col(n)).alias(n) for n in names))


def _keys(df: DataFrame, dims: list[str]) -> DataFrame:
    """Add k0, k1, ...: for each dimension an ordered 62-bit key, its range over all rows and then the text's hash."""
    number = lambda d: F.when(~F.isnan(d), F.col(d))
    ranges = df.agg(*(f(number(d)).alias(f"{n}{k}") for k, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    columns = []
    for k, d in enumerate(dims):
        lo, hi = ranges[f"lo{k}"], ranges[f"hi{k}"]
        top = (1 << _DIM_BITS) - 2
        part = F.floor((F.col(d) - lo) / (hi - lo) * top) + 1 if lo is not None and hi > lo else F.lit(1)
        part = F.coalesce(F.when(F.isnan(d) | F.col(d).isNull(), 0).otherwise(part), F.lit(0)).cast("long")
        columns.append(
            F.shiftleft(part, _HASH_BITS).bitwiseOR(F.shiftrightunsigned("text_hash", 64 - _HASH_BITS)).alias(f"k{k}")
        )
    return df.select("*", *columns)


def shard(
    df: DataFrame, dims: dict[str, Column], text: str = "text", shards: int | None = None, target_bytes: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of ``keep`` with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    dims: metadata columns, numbers or strings. Give the number of shards, or the bytes that a leaf should have.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"_d{k}" for k in range(len(dims))]
    kept = [f"_kept{k}" for k in range(len(keep))]  # whatever the caller's columns are called
    read = cut(
        df.select(
            *(F.col(c).alias(n) for c, n in zip(keep, kept)), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("text_hash"), F.monotonically_increasing_id().alias("uid"), *(c.alias(n) for n, c in zip(names, dims.values())),
        ),
        "kd-rows",
    )
    meta = read
    for n in names:
        meta = _codes(meta, n) if meta.schema[n].dataType.simpleString() == "string" else meta.withColumn(n, F.col(n).cast("double"))
    meta = cut(_same_for_equal_texts(meta, names), "kd-groups")
    keyed = _keys(meta, names).drop(*names, "text_hash")
    if shards is None:
        shards = max(1, -(-(meta.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    out = slots(kd_tree(keyed, len(dims), shards))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, kept)), "size", "text_crc32", "shard", "slot")


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, cut along language, source and length."""
    dims = {"lang": F.col("lang"), "source": F.col("source"), "length": F.log1p(F.length("text"))}
    out = shard(documents(spark, sf_dir), dims, shards=40, keep=("doc_id",))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
